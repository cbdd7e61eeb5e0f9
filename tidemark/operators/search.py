"""Parameter search by successive halving over walk-forward folds.

The state of the search is a table of (app, tier, candidate) that are still in it. A round scores all of them on their next
fold in one job, of all apps and tiers at once; then the worse half of each app and tier, by the mean of its folds so far,
leaves by an anti-join. So 150 drawn candidates keep their own trees and depth, and only the best meet the later, longer
folds. There are as many rounds as a tier has folds, six at most.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.params import from_json_text, to_json_text
from tidemark.operators.app_models import USED, fit_frame, levels_of, spread, used_values
from tidemark.operators.boosting import BoostParams
from tidemark.operators.forecast import numbered
from tidemark.operators.tuning import (
    TREES_BASE, TREES_CAP, TREES_STEP, app_sizes, draw_candidates, save_tuned_params, size_tiers, walk_forward_folds, with_fold_params,
)
from tidemark.session import cut_lineage
from tidemark.sources.tables import TableStore

KEY = ["app_id", "tier_size"]
#: Tasks that the candidates of one app and tier are dealt to.
CHUNKS = 8


def candidate_table(spark: SparkSession, n_trials: int, seed: int = 42, fixed: list[BoostParams] | None = None) -> DataFrame:
    """``max_trees, candidate, params``: the same draws for the same seed, for each of the few tree limits."""
    rows = [
        (most, k, to_json_text(c))
        for most in range(TREES_BASE, TREES_CAP + 1, TREES_STEP)
        for k, c in enumerate(draw_candidates(n_trials, most, seed) if fixed is None else fixed)
    ]
    return spark.createDataFrame(rows, "max_trees int, candidate int, params string")


def fold_scores(rows: DataFrame, work: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """``app_id, tier_size, candidate, fold, mape`` of every ``work`` row: its 1-step error in percent on its fold.

    ``rows`` are numbered matrix rows. A task fits the candidates of one chunk of an app and tier, on ``tier_size`` rows
    at most.
    """
    dealt = work.withColumn("chunk", F.col("candidate") % chunks)
    spans = dealt.groupBy(*KEY, "chunk").agg(F.max("test_end").alias("upto"))
    own = F.col("position") - (F.col("n_rows") - F.col("tier_size"))
    data = rows.join(spans, "app_id").withColumn("place", own).filter((F.col("place") > 0) & (F.col("place") <= F.col("upto"))).select(
        *[F.col(c).alias(c) for c in [*KEY, "chunk"]], "place", "target_y_abs", *USED)

    def score(key: tuple, frame: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("place"), []
        for c in candidates.itertuples(index=False):
            train, test = frame.iloc[: c.train_end], frame.iloc[c.train_end : c.test_end]
            trees, names, _ = fit_frame(train, from_json_text(c.params))
            predicted = levels_of(test, trees.predict(used_values(test, names)))
            actual = test["target_y_abs"].to_numpy(dtype=float)
            out.append((c.app_id, c.tier_size, c.candidate, c.fold, float(np.mean(np.abs(actual - predicted) / np.maximum(actual, 1.0)) * 100)))
        return pd.DataFrame(out, columns=[*KEY, "candidate", "fold", "mape"])

    keys = [*KEY, "chunk"]
    return spread(data, keys).groupBy(*keys).cogroup(spread(dealt, keys).groupBy(*keys)).applyInPandas(
        score, "app_id long, tier_size int, candidate int, fold int, mape double")


def tier_plan(matrix: DataFrame) -> DataFrame:
    """Every tier of every app, with its fold settings."""
    return with_fold_params(size_tiers(app_sizes(matrix)))


def halving_search(
    matrix: DataFrame, n_trials: int = 150, candidates: list[BoostParams] | None = None, plan: DataFrame | None = None,
    seed: int = 42, keep: float = 0.5, chunks: int = CHUNKS,
) -> DataFrame:
    """The best candidate of each app and tier, as rows of the tuning table.

    ``keep`` is the share that stays after a fold; 1.0 is the full search. An app or tier with too few rows for a fold has
    a row with the default parameters, no score, and no trials.
    """
    rows = cut_lineage(numbered(matrix))
    plan = cut_lineage(tier_plan(matrix) if plan is None else plan)
    folds = cut_lineage(walk_forward_folds(plan).select(*KEY, "fold", "train_end", "test_end"))
    n_folds = folds.groupBy(*KEY).agg(F.count("*").cast("int").alias("n_folds"))
    alive = plan.select(*KEY, "max_trees").join(
        candidate_table(matrix.sparkSession, n_trials, seed, candidates), "max_trees").join(n_folds, KEY)
    alive = cut_lineage(alive.drop("max_trees"))
    scores: list[DataFrame] = []
    for fold in range(folds.agg(F.max("fold")).first()[0] + 1 if not folds.isEmpty() else 0):
        work = alive.join(folds.filter(F.col("fold") == fold), KEY)
        scores.append(cut_lineage(fold_scores(rows, work, chunks)))
        means = reduce(DataFrame.unionByName, scores).join(alive.select(*KEY, "candidate", "n_folds"), [*KEY, "candidate"]).filter(
            F.col("n_folds") > fold + 1).groupBy(*KEY, "candidate").agg(F.avg("mape").alias("mean"))
        placed = means.withColumns({
            "place": F.row_number().over(Window.partitionBy(*KEY).orderBy("mean", "candidate")),
            "n": F.count("*").over(Window.partitionBy(*KEY))})
        losers = placed.filter(F.col("place") > F.ceil(F.col("n") * keep)).select(*KEY, "candidate")
        alive = cut_lineage(alive.join(losers, [*KEY, "candidate"], "left_anti"))
    columns = ["params", "score", "mape_multistep_pct", "mape_1step_pct", "mape_multistep_std", "n_trials", "n_folds"]
    untried = plan.join(n_folds, KEY, "left_anti").select(
        *KEY, F.lit(to_json_text(BoostParams())).alias("params"), *[F.lit(None).cast("double").alias(c) for c in columns[1:5]],
        F.lit(0).alias("n_trials"), F.lit(0).alias("n_folds"))
    if not scores:
        return untried
    whole = reduce(DataFrame.unionByName, scores).join(alive, [*KEY, "candidate"]).groupBy(*KEY, "candidate", "params", "n_folds").agg(
        F.avg("mape").alias("score"), F.stddev_pop("mape").alias("std"))
    best = whole.groupBy(*KEY).agg(F.min(F.struct("score", "candidate", "std", "params", "n_folds")).alias("b"))
    tried = n_trials if candidates is None else len(candidates)
    return best.select(
        *KEY, "b.params", "b.score",
        # Only the 1-step error is measured in the search; no multi-step figure is claimed.
        F.lit(None).cast("double").alias("mape_multistep_pct"), F.col("b.score").alias("mape_1step_pct"),
        F.col("b.std").alias("mape_multistep_std"), F.lit(tried).alias("n_trials"), "b.n_folds",
    ).unionByName(untried)


def run_tuning_cycle(
    store: TableStore, matrix: DataFrame, as_of: datetime, n_trials: int = 150, force: bool = False,
    candidates: list[BoostParams] | None = None, only: DataFrame | None = None,
) -> list[int]:
    """Tunes the tiers each app lacks (all with ``force``), all in one search; returns the tier sizes tuned."""
    matrix = cut_lineage(matrix if only is None else matrix.join(only.select("app_id"), "app_id", "left_semi"))
    plan = tier_plan(matrix)
    plan = plan.join(walk_forward_folds(plan).select(*KEY).distinct(), KEY)
    if not force:
        plan = plan.join(store.read("hyperparameter_tuning").select(*KEY), KEY, "left_anti")
    plan = cut_lineage(plan)
    tuned = cut_lineage(halving_search(matrix, n_trials, candidates, plan))
    save_tuned_params(store, tuned, app_sizes(matrix), as_of)
    return [r["tier_size"] for r in tuned.select("tier_size").distinct().orderBy("tier_size").collect()]
