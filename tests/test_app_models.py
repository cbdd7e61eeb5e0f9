import math
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_forecast import make_kpis, no_reviews, weekly
from tidemark.functions.params import from_json_text
from tidemark.operators import app_models as A
from tidemark.operators import forecast as FC
from tidemark.operators import matrix as X
from tidemark.operators import search as S
from tidemark.operators.boosting import BoostParams
from tidemark.operators.newton import Columns, fit_trees
from tidemark.session import cut_lineage

PLAIN = BoostParams(n_estimators=1, max_depth=1, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0, reg_alpha=0.0, reg_lambda=0.0)


@pytest.fixture(scope="module")
def matrix(spark):
    return cut_lineage(X.daily_matrix(make_kpis(spark, {1: weekly(70), 2: weekly(70, 50, 1.2)}), no_reviews(spark)))


def sample(n=60, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 3)).astype(float)
    return x, x[:, 1] * 2 + (x[:, 2] > 4) + rng.normal(size=n), rng.uniform(0.5, 2, n)


@pytest.mark.parametrize("p", [PLAIN, replace(PLAIN, reg_lambda=3.0, reg_alpha=5.0, min_child_weight=20.0, asymmetric_alpha=4.0)])
def test_one_split_equals_brute_force(p):
    x, y, w = sample()
    h = w * np.where(y.mean() < y, p.asymmetric_alpha, 1.0)
    g = h * (y.mean() - y)

    def value(rows):
        top = math.copysign(max(abs(g[rows].sum()) - p.reg_alpha, 0.0), g[rows].sum())
        return top, h[rows].sum() + p.reg_lambda

    def gain(rows):
        top, bottom = value(rows)
        return top * top / bottom

    splits = [(gain(right) + gain(~right), f, c, right) for f in range(3) for c in np.arange(8) + 0.5
              for right in [x[:, f] > c] if min(h[right].sum(), h[~right].sum()) >= p.min_child_weight]
    _, feature, cut, right = max(splits, key=lambda s: (s[0], -s[1], -s[2]))
    trees, fitted = fit_trees(Columns.of(x, []), y, w, p)
    assert trees.feature[0, 0] == feature and trees.cut[0, 0] == pytest.approx(cut)
    for side in (right, ~right):
        top, bottom = value(side)
        assert fitted[side] == pytest.approx(y.mean() - top / bottom)
    assert trees.predict(x) == pytest.approx(fitted)


def test_sparse_features_are_those_of_dense_columns():
    x, y, w = sample()
    x[:, 1] *= x[:, 1] > 3
    p = replace(PLAIN, n_estimators=20, max_depth=4, learning_rate=0.3, subsample=0.8)
    rows = np.flatnonzero(x[:, 1])
    dense, _ = fit_trees(Columns.of(x[:, [0, 2, 1]], []), y, w, p)
    sparse, _ = fit_trees(Columns.of(x[:, [0, 2]], [(rows, x[rows, 1])]), y, w, p)
    assert (dense.feature == sparse.feature).all() and dense.leaf == pytest.approx(sparse.leaf)


def test_gamma_stops_and_trees_learn():
    x, y, w = sample(400)
    none, _ = fit_trees(Columns.of(x, []), y, w, replace(PLAIN, gamma=1e9))
    assert (none.feature == -1).all()
    p = BoostParams()
    trees, fitted = fit_trees(Columns.of(x, []), y, w, p, asymmetric=False)
    assert trees.predict(x) == pytest.approx(fitted) and np.var(y - fitted) < 0.3 * np.var(y)
    assert trees.feature.shape == (150, 63)


def test_models_are_each_apps_own(matrix):
    p = BoostParams(n_estimators=20, max_depth=3, learning_rate=0.3)
    both = {r["app_id"]: r for r in A.fit_apps(matrix, p).collect()}
    alone = A.fit_apps(matrix.filter("app_id = 2"), p).first()
    assert set(both) == {1, 2} and both[2] == alone and both[1]["samples"] == matrix.filter("app_id = 1").count()
    scored = A.predict_apps(matrix, A.fit_apps(matrix, p))
    spread = {r["app_id"]: r["v"] for r in scored.groupBy("app_id").agg(F.var_pop(F.col("target_y") - F.col("prediction")).alias("v")).collect()}
    assert all(both[a]["residual_var"] == pytest.approx(spread[a]) for a in both)
    mixed = matrix.sparkSession.createDataFrame([(1, '{"max_depth": 2, "n_estimators": 5}')], "app_id long, params string")
    depths = {r["app_id"]: r["depth"] for r in A.fit_apps(matrix, mixed).collect()}
    assert depths == {1: 2, 2: 6}  # the fixed parameters where nothing is tuned


@pytest.mark.parametrize("training_lags", [True, False])
def test_forecast_follows_the_recursion(matrix, training_lags):
    """Against one written out row by row, predictions taken from the same model by the other way of asking."""
    spark = matrix.sparkSession
    models = cut_lineage(A.fit_apps(matrix, BoostParams(n_estimators=15, max_depth=3, learning_rate=0.3)))
    found = A.forecast_apps(matrix, models, 9, 1.1, training_lags).filter("app_id = 1").orderBy("step").collect()
    own = matrix.filter("app_id = 1")
    history = [r["mean_concurrent"] for r in own.orderBy("date").collect()]
    row, variance = own.orderBy(F.desc("date")).first().asDict(), models.filter("app_id = 1").first()["residual_var"]
    last, shift = row["date"], 1 if training_lags else 0
    assert len(found) == 9
    for step, got in enumerate(found, 1):
        ratio = max(-2.0, min(2.0, A.predict_apps(spark.createDataFrame([row], matrix.schema), models).first()["prediction"]))
        level, previous, day = row["mean_concurrent"] * math.exp(ratio), history[-1], last + timedelta(step)
        assert got["predicted_mean_concurrent"] == pytest.approx(level * math.exp(step * variance / 2) * 1.1)
        assert (got["date"], got["step"]) == (day, step)
        history.append(level)
        back, weekend = history[: len(history) - shift], int(day.weekday() >= 5)
        row |= {
            "mean_concurrent": level, "kpi_lag_1": back[-1], "kpi_lag_7": back[-7], "kpi_roll_7_mean": sum(back[-7:]) / 7,
            "kpi_roll_7_max": max(back[-7:]), "pct_change": (level - previous) / previous * (100 if training_lags else 1),
            "dayofweek": day.weekday(), "is_weekend": weekend, "dow_sin": math.sin(2 * math.pi * day.weekday() / 7),
            "dow_cos": math.cos(2 * math.pi * day.weekday() / 7), "lag7_weekend_interaction": back[-7] * weekend,
        }
        if training_lags:
            row |= {"kpi_lag_14": back[-14], "weekend_boost_ratio": back[-7] / (sum(back[-7:]) / 7 + 1e-5) * weekend}


def test_rules_decay_to_their_mean(matrix):
    lifted = matrix.withColumn("rule_lifts", F.when(F.dayofmonth("date") % 2 == 0, F.create_map(F.lit("rule_lift_x"), F.lit(2.0))).otherwise(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))).withColumn(
        "target_y", F.size("rule_lifts") / 10.0)
    models = A.fit_apps(lifted, BoostParams(n_estimators=30, max_depth=2, learning_rate=0.3))
    assert all("rule_lift_x" in r["names"] for r in models.collect())
    scored = A.predict_apps(lifted, models)
    assert scored.filter(F.abs(F.col("prediction") - F.col("target_y")) > 0.03).isEmpty()


def test_a_hundred_thousand_rules_fit(matrix):
    """Entries are what a rule costs: every app has 100,000 rule features, some on each day."""
    n = 100_000
    day = F.date_diff("date", F.lit(date(2001, 1, 1)))
    names = F.transform(F.sequence((day * n / 70).cast("int"), ((day + 1) * n / 70).cast("int")), lambda i: F.concat(F.lit("rule_lift_"), i.cast("string")))
    wide = cut_lineage(matrix.withColumn("rule_lifts", F.map_from_arrays(names, F.transform(names, lambda _: F.lit(1.5)))))
    models = A.fit_apps(wide, BoostParams(n_estimators=2, max_depth=2)).collect()
    assert len(models) == 2 and all(len(r["names"]) <= 6 for r in models)
    numbered = X.rule_dictionary(wide)
    count, low, high, kinds = numbered.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
    assert low == 0 and count == kinds == high + 1 > 98_000


def test_benchmark_scores_all_test_days(matrix):
    p = BoostParams(n_estimators=20, max_depth=3, learning_rate=0.3)
    metrics, rows = A.benchmark_apps(matrix, p)
    by_app = {r["app_id"]: r for r in metrics.collect()}
    assert {(r["train_samples"], r["test_samples"], r["evaluated_days"]) for r in by_app.values()} == {(48, 21, 21)}
    levels = {(r["app_id"], r["date"]): r["target_y_abs"] for r in matrix.collect()}
    assert all(r["actual_kpi"] == levels[r["app_id"], r["date"]] for r in rows.collect())
    assert by_app[1]["mape_1step_pct"] < 25
    _, shifted = A.benchmark_apps(matrix, p, pairing="shifted")
    late = {(r["app_id"], r["step"]): r["pred_multistep"] for r in rows.collect()}
    assert all(r["pred_multistep"] == pytest.approx(late[r["app_id"], r["step"] - 1]) for r in shifted.collect() if r["step"] > 1)


# --- Search ---------------------------------------------------------------------------------


def test_the_survivor_is_the_best_of_the_full_search(spark, matrix):
    """One good set among poor ones; an app without a fold gets the default parameters."""
    more = matrix.unionByName(matrix.filter("app_id = 1").limit(20).withColumn("app_id", F.lit(3).cast("long")))
    poor = [BoostParams(n_estimators=1, max_depth=1, learning_rate=0.001, seed=k) for k in range(5)]
    sets = [*poor[:3], BoostParams(n_estimators=30, max_depth=3, learning_rate=0.3), *poor[3:]]
    half = {(r["app_id"], r["tier_size"]): r for r in S.halving_search(more, candidates=sets, chunks=2).collect()}
    full = {(r["app_id"], r["tier_size"]): r for r in S.halving_search(more, candidates=sets, keep=1.0, chunks=3).collect()}
    assert half == full and set(half) == {(1, 69), (2, 69), (3, 20)}
    assert half[3, 20]["n_folds"] == 0 and half[3, 20]["score"] is None and from_json_text(half[3, 20]["params"]) == BoostParams()
    for app in (1, 2):
        r = half[app, 69]
        assert from_json_text(r["params"]) == sets[3] and r["n_folds"] == 4 and r["n_trials"] == 6 and r["mape_1step_pct"] == r["score"]


def test_half_leaves_after_each_fold(spark, matrix, monkeypatch):
    seen = []

    def watched(rows, work, chunks):
        seen.append(work.groupBy("app_id").count().collect())
        return work.select(*S.KEY, "candidate", "fold", (F.col("candidate") * 1.0).alias("mape"))

    monkeypatch.setattr(S, "fold_scores", watched)
    out = S.halving_search(matrix, n_trials=12).collect()
    assert [{r["count"] for r in s} for s in seen] == [{12}, {6}, {3}, {2}]
    # a draw keeps its own trees and depth
    drawn = S.candidate_table(spark, 12).filter("candidate = 0").collect()
    assert {r["params"] for r in out} <= {r["params"] for r in drawn} and len({r["params"] for r in drawn}) > 1


def test_fold_scores_by_hand(spark, matrix):
    p = BoostParams(n_estimators=5, max_depth=2)
    plan = S.tier_plan(matrix)
    from tidemark.operators.tuning import walk_forward_folds
    folds = walk_forward_folds(plan).filter("app_id = 2 AND fold = 1")
    work = folds.select(*S.KEY, "fold", "train_end", "test_end").crossJoin(S.candidate_table(spark, 1, fixed=[p]).filter("max_trees = 50").drop("max_trees"))
    found, fold = S.fold_scores(FC.numbered(matrix), work).first(), folds.first()
    frame = pd.DataFrame([r.asDict() for r in matrix.filter("app_id = 2").orderBy("date").collect()])
    train, test = frame.iloc[: fold["train_end"]], frame.iloc[fold["train_end"] : fold["test_end"]]
    trees, names, _ = A.fit_frame(train, p)
    level = test["mean_concurrent"] * np.exp(np.clip(trees.predict(A.used_values(test, names)), -2, 2))
    assert found["mape"] == pytest.approx((abs(test["target_y_abs"] - level) / test["target_y_abs"]).mean() * 100)
