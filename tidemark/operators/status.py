"""Runs, tuning records and freshness, per app."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_HOURS = 24
REPORT_RULES = 15


def run_overview(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every run with its number of rules, runs without rules included."""
    counts = rules.groupBy("app_id", "run_id").agg(F.count("rule_id").alias("total_rules"))
    return (
        runs.join(counts, ["app_id", "run_id"], "left")
        .select(
            "app_id", "run_id", "timestamp", "total_reviews",
            F.coalesce("total_rules", F.lit(0)).alias("total_rules"),
            "min_support", "min_confidence", "min_lift",
        )
    )


def newest_first(overview: DataFrame) -> DataFrame:
    return overview.orderBy(F.desc("timestamp"), "app_id")


def latest_run(runs: DataFrame) -> DataFrame:
    """``app_id, run_id`` of the most recent run."""
    return runs.groupBy("app_id").agg(F.max_by("run_id", F.struct("timestamp", "run_id")).alias("run_id"))


def top_rules(rules: DataFrame, runs: DataFrame, n: int = REPORT_RULES) -> DataFrame:
    """The ``n`` rules of highest lift of each app's latest run, with their rank."""
    of_latest = rules.join(latest_run(runs), ["app_id", "run_id"], "left_semi")
    by_lift = Window.partitionBy("app_id").orderBy(
        F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequents"
    )
    return of_latest.withColumn("rank", F.row_number().over(by_lift)).filter(F.col("rank") <= n)


def known_apps(*tables: DataFrame) -> DataFrame:
    ids = [t.select("app_id").distinct() for t in tables]
    united = ids[0]
    for other in ids[1:]:
        united = united.unionByName(other)
    return united.distinct()


def needing_initialisation(apps: DataFrame, runs: DataFrame) -> DataFrame:
    return apps.join(runs.select("app_id"), "app_id", "left_anti")


def last_update(apps: DataFrame, runs: DataFrame) -> DataFrame:
    """Time of the latest run per app, null without runs."""
    latest = runs.groupBy("app_id").agg(F.max("timestamp").alias("last_updated"))
    return apps.join(latest, "app_id", "left")


def stale_apps(
    apps: DataFrame, runs: DataFrame, as_of: datetime | Column,
    disabled: DataFrame | None = None, skipped_today: DataFrame | None = None,
) -> DataFrame:
    """Apps whose last run is more than a day old or missing, unless switched off."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    due = last_update(apps, runs).filter(
        F.col("last_updated").isNull() | (F.col("last_updated") < now - F.expr(f"INTERVAL {STALE_HOURS} HOURS"))
    )
    for excluded in (disabled, skipped_today):
        if excluded is not None:
            due = due.join(excluded.select("app_id"), "app_id", "left_anti")
    return due


def tuning_history(records: DataFrame) -> DataFrame:
    return records.orderBy("app_id", "tier_size")


def latest_tuning(records: DataFrame) -> DataFrame:
    newest = records.groupBy("app_id").agg(F.max(F.struct("timestamp", "tier_size")).alias("__newest"))
    return (
        records.join(newest, "app_id")
        .filter((F.col("timestamp") == F.col("__newest.timestamp")) & (F.col("tier_size") == F.col("__newest.tier_size")))
        .drop("__newest")
    )


def params_for_size(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """``app_id, tier_size, params`` of the largest tier within ``n_samples``, else the smallest tier."""
    fits = F.col("tier_size") <= F.col("n_samples")
    chosen = records.join(sizes.select("app_id", "n_samples"), "app_id").groupBy("app_id").agg(
        F.max_by(F.struct("tier_size", "params"), F.when(fits, F.col("tier_size"))).alias("largest"),
        F.min_by(F.struct("tier_size", "params"), "tier_size").alias("smallest"),
    )
    best = F.coalesce("largest", "smallest")
    return chosen.select("app_id", best["tier_size"].alias("tier_size"), best["params"].alias("params"))
