"""Mining runs from stored reviews: current window, historical windows, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.phrases import severity, with_sentence
from tidemark.operators import reviews as R
from tidemark.operators.mining import mine
from tidemark.operators.status import top_rules
from tidemark.schemas import RULE_METRICS
from tidemark.session import cut_lineage
from tidemark.skew import attach_by_group
from tidemark.sources.tables import TableStore


WINDOW = ["app_id", "window_no"]


@dataclass(frozen=True)
class MiningParams:
    min_support: float = 0.02
    min_confidence: float = 0.5
    min_lift: float = 1.2
    deduplicate_mode: str = "both"
    min_reviews: int = R.MIN_REVIEWS


def run_id(app_id: Column, timestamp: Column, window_days: Column, params: MiningParams) -> Column:
    """``run_YYYYMMDD_HHMMSS_xxxx``; the suffix is a digest, so a repeated job gives the same id."""
    settings = f"{params.min_support}|{params.min_confidence}|{params.min_lift}|{params.deduplicate_mode}"
    digest = F.sha2(F.concat_ws("|", app_id, timestamp, window_days, F.lit(settings)), 256)
    return F.concat(
        F.lit("run_"), F.date_format(timestamp, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(digest, 1, 4)
    )


def mining_dataset(reviews: DataFrame, kpis: DataFrame, as_of: int, min_reviews: int = R.MIN_REVIEWS) -> DataFrame:
    """Baskets of each app's current look-back, with its length ``window_days``."""
    windows = R.window_size(reviews, as_of, min_reviews)
    return R.review_baskets(R.in_lookback(reviews, windows, as_of), kpis, "window_days")


def historical_baskets(
    reviews: DataFrame, kpis: DataFrame, as_of: int, min_reviews: int = R.MIN_REVIEWS,
    window_days: int = 14, step_days: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Baskets per ``app_id, window_no`` for windows with enough reviews, and those windows."""
    windowed = R.in_sliding_windows(reviews, as_of, window_days, step_days)
    windows = R.windows_with_enough(windowed, min_reviews)
    baskets = R.review_baskets(windowed, kpis, "window_no")
    kept = attach_by_group(
        baskets, windows.select("app_id", "window_no"), ["app_id", "window_no"], ["recommendationid"]
    )
    return kept, windows


def mining_records(rules: DataFrame, runs: DataFrame, keys: Sequence[str], params: MiningParams) -> tuple[DataFrame, DataFrame]:
    """Rows of ``association_rules``, and of ``mining_runs`` for the runs that have rules.

    ``runs`` holds ``keys``, ``timestamp``, ``window_size_days`` and ``total_reviews``. Ids are
    digests of their content: a job repeated after a failure does not store anything twice.
    """
    stamped = runs.withColumn(
        "run_id", run_id(F.col("app_id"), F.col("timestamp"), F.col("window_size_days"), params)
    )
    named = rules.join(stamped.select(*keys, "run_id"), list(keys)).withColumn(
        "rule_id", F.sha2(F.concat_ws("|", "app_id", "run_id", "antecedents", "consequents"), 256)
    )
    named = cut_lineage(named.select("app_id", "rule_id", "run_id", "antecedents", "consequents", *RULE_METRICS))
    records = (
        stamped.join(named.select("app_id", "run_id").distinct(), ["app_id", "run_id"], "left_semi")
        .withColumn("min_support", F.lit(params.min_support))
        .withColumn("min_confidence", F.lit(params.min_confidence))
        .withColumn("min_lift", F.lit(params.min_lift))
        .withColumn("deduplicate_mode", F.lit(params.deduplicate_mode))
    )
    return named, records


def save_mining_results(store: TableStore, rules: DataFrame, runs: DataFrame, keys: Sequence[str], params: MiningParams) -> None:
    """Appends the runs that have rules, and their rules."""
    named, records = mining_records(rules, runs, keys, params)
    store.insert_or_ignore("mining_runs", records)
    store.insert_or_ignore("association_rules", named)


def run_current(store: TableStore, as_of: int, params: MiningParams = MiningParams(), save: bool = True) -> DataFrame:
    """Mines each app's current look-back and stores the run as of now."""
    reviews, kpis = store.read("reviews"), store.read("daily_kpis")
    baskets = mining_dataset(reviews, kpis, as_of, params.min_reviews)
    rules = cut_lineage(
        mine(baskets, ["app_id"], params.min_support, params.min_confidence, params.min_lift, params.deduplicate_mode)
    )
    if save:
        runs = baskets.groupBy("app_id").agg(
            F.any_value("window_days").cast("int").alias("window_size_days"),
            F.count("*").cast("int").alias("total_reviews"),
        ).withColumn("timestamp", F.timestamp_seconds(F.lit(as_of)))
        save_mining_results(store, rules, runs, ["app_id"], params)
    return rules


def mine_history(
    store: TableStore, as_of: int, params: MiningParams, window_days: int = 14, step_days: int = 7,
    app_ids: Sequence[int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rules and runs per ``app_id, window_no`` of all windows of all apps, or of ``app_ids``, in one pass."""
    reviews, kpis = store.read("reviews"), store.read("daily_kpis")
    if app_ids is not None:
        reviews = reviews.filter(F.col("app_id").isin(list(app_ids)))
    baskets, windows = historical_baskets(reviews, kpis, as_of, params.min_reviews, window_days, step_days)
    rules = cut_lineage(
        mine(baskets, WINDOW, params.min_support, params.min_confidence, params.min_lift, params.deduplicate_mode)
    )
    runs = windows.select(
        *WINDOW,
        F.timestamp_seconds("window_end").alias("timestamp"),
        F.lit(window_days).alias("window_size_days"),
        F.col("total_reviews").cast("int").alias("total_reviews"),
    )
    return rules, runs


def run_historical(
    store: TableStore, as_of: int, params: MiningParams = MiningParams(),
    window_days: int = 14, step_days: int = 7, app_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Mines the history and adds its runs; a run carries the end of its window as its time."""
    rules, runs = mine_history(store, as_of, params, window_days, step_days, app_ids)
    save_mining_results(store, rules, runs, WINDOW, params)
    return rules


def remine(store: TableStore, app_ids: Sequence[int], as_of: int, params: MiningParams = MiningParams()) -> DataFrame:
    """Mines the history of the apps again; rules and runs of these apps give way to the new ones in one commit.

    Other apps are left alone. Until the commit readers see the old runs, also where the job dies on the way.
    """
    rules, runs = mine_history(store, as_of, params, app_ids=app_ids)
    named, records = mining_records(rules, runs, WINDOW, params)
    apps = store.spark.createDataFrame([(int(app_id),) for app_id in app_ids], "app_id long")
    store.replace({"association_rules": named, "mining_runs": records}, apps)
    return rules


def report(rules: DataFrame, runs: DataFrame) -> DataFrame:
    """The strongest rules of each app's latest run as sentences with a severity."""
    return with_sentence(top_rules(rules, runs)).select(
        "app_id", "rank", "text", severity(F.col("lift")).alias("category"), "antecedents", "consequents"
    )
