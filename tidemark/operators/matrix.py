"""The daily feature matrix: usage levels, review aggregates, calendar and rule features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.reviews import utc_day
from tidemark.operators.reviews import non_spam
from tidemark.schemas import PILLARS
from tidemark.session import cut_lineage
from tidemark.skew import attach_by_group

EPSILON = 1e-5
# The feature of a pillar is named after it, with one exception.
PILLAR_FEATURES = {p: "avg_monetization" if p == "monetizationModel" else f"avg_{p}" for p in PILLARS}
REVIEW_FEATURES = ["daily_review_count", *PILLAR_FEATURES.values(), "positive_ratio"]
LEVEL_FEATURES = [
    "mean_concurrent", "kpi_lag_1", "kpi_lag_7", "kpi_lag_14", "kpi_roll_7_mean", "kpi_roll_7_max",
    "lag7_weekend_interaction",
]
CALENDAR_FEATURES = ["dayofweek", "is_weekend", "dow_sin", "dow_cos"]


def daily_review_features(reviews: DataFrame) -> DataFrame:
    """Count, pillar means and share of positive reviews per app and UTC day, without spam."""
    dated = non_spam(reviews).withColumn("date", utc_day(F.col("timestamp_updated")))
    return dated.groupBy("app_id", "date").agg(
        F.count("*").alias("daily_review_count"),
        *[F.avg(p).alias(name) for p, name in PILLAR_FEATURES.items()],
        F.avg(F.when(F.col("voted_up"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("positive_ratio"),
    )


def rule_feature():
    return F.concat(F.lit("rule_lift_"), "antecedents", F.lit("_->"), "consequents")


def daily_rule_lifts(rules: DataFrame, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """``rule_lifts``, a map from rule feature to its highest lift, per app and day of the run."""
    if run_id is not None:
        rules = rules.filter(F.col("run_id") == run_id)
    dated = rules.join(runs.select("app_id", "run_id", "timestamp"), ["app_id", "run_id"]).select(
        "app_id", F.to_date("timestamp").alias("date"), rule_feature().alias("feature"), "lift"
    )
    best = dated.groupBy("app_id", "date", "feature").agg(F.max("lift").alias("lift"))
    return best.groupBy("app_id", "date").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "lift"))).alias("rule_lifts")
    )


def calendar(date) -> dict:
    day = F.weekday(date)
    angle = F.lit(2 * math.pi) * day / F.lit(7.0)
    return {
        "dayofweek": day,
        "is_weekend": F.when(day >= 5, F.lit(1)).otherwise(F.lit(0)),
        "dow_sin": F.sin(angle),
        "dow_cos": F.cos(angle),
    }


def daily_matrix(
    kpis: DataFrame, reviews: DataFrame, rules: DataFrame | None = None, runs: DataFrame | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """One row per app and stored day whose following level is known.

    Lags count rows, not calendar days, and are 0 where the history is too short. ``target_y`` is
    the log-ratio of the next level to this one; ``target_y_abs`` and ``target_date`` are that next
    level and its day, for scoring only.
    """
    days = kpis.select("app_id", "date", "mean_concurrent", "pct_change")
    joined = days.join(daily_review_features(reviews), ["app_id", "date"], "left")
    no_rules = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    if rules is not None and runs is not None:
        joined = joined.join(daily_rule_lifts(rules, runs, run_id), ["app_id", "date"], "left").withColumn(
            "rule_lifts", F.coalesce("rule_lifts", no_rules)
        )
    else:
        joined = joined.withColumn("rule_lifts", no_rules)
    filled = joined.fillna(0, ["mean_concurrent", "pct_change", *REVIEW_FEATURES])
    ordered = Window.partitionBy("app_id").orderBy("date")
    before = ordered.rowsBetween(-7, -1)
    level = F.col("mean_concurrent")
    windowed = filled.withColumns({
        **{f"kpi_lag_{k}": F.lag("mean_concurrent", k).over(ordered) for k in (1, 7, 14)},
        "kpi_roll_7_mean": F.avg("mean_concurrent").over(before),
        "kpi_roll_7_max": F.max("mean_concurrent").over(before),
        "target_y_abs": F.lead("mean_concurrent").over(ordered),
        "target_date": F.lead("date").over(ordered),
    }).fillna(0, ["kpi_lag_1", "kpi_lag_7", "kpi_lag_14", "kpi_roll_7_mean", "kpi_roll_7_max"])
    return (
        windowed.withColumns(calendar(F.col("date")))
        .withColumns({
            "lag7_weekend_interaction": F.col("kpi_lag_7") * F.col("is_weekend"),
            "weekend_boost_ratio": F.col("kpi_lag_7") / (F.col("kpi_roll_7_mean") + EPSILON) * F.col("is_weekend"),
            # ln(0) is null, so days before a zero level drop out like the last day.
            "target_y": F.ln(F.col("target_y_abs") / F.nullif(level, F.lit(0.0))),
        })
        .dropna(subset=["target_y"])
    )


def rule_dictionary(matrix: DataFrame) -> DataFrame:
    """``feature, idx`` of all rule features in name order, numbered from 0 where they lie.

    Ranges of names are ordered by their own tasks; a range's first number is the size of those before it, from a row per
    range. No list of names is made on the driver.
    """
    names = matrix.select(F.explode(F.map_keys("rule_lifts")).alias("feature")).distinct()
    within = F.monotonically_increasing_id()  # the task's number, and the row's within it
    ordered = cut_lineage(names.repartitionByRange("feature").sortWithinPartitions("feature").select(
        "feature", F.shiftright(within, 33).alias("part"), within.bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return attach_by_group(ordered, starts, ["part"], ["feature"]).select("feature", (F.col("start") + F.col("place")).alias("idx"))


def rule_vectors(matrix: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``app_id, date, indices, values``: the lifts of each day's rules, sparse, in index order."""
    entries = matrix.select("app_id", "date", F.explode("rule_lifts").alias("feature", "lift"))
    placed = attach_by_group(entries, dictionary, ["feature"], ["app_id", "date"])
    sorted_entries = F.array_sort(F.collect_list(F.struct("idx", "lift")))
    return placed.groupBy("app_id", "date").agg(sorted_entries.alias("e")).select(
        "app_id", "date", F.col("e.idx").alias("indices"), F.col("e.lift").alias("values"))


def rule_feature_names(matrix: DataFrame) -> list[str]:
    """All rule features of the matrix; a model has one per distinct rule of its own pool of apps."""
    names = matrix.select(F.explode(F.map_keys("rule_lifts")).alias("name")).distinct()
    return [r["name"] for r in names.orderBy("name").collect()]


def with_rule_columns(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """The wide form: one column per rule feature, 0 where the rule was not found."""
    return matrix.withColumns(
        {name: F.coalesce(F.try_element_at("rule_lifts", F.lit(name)), F.lit(0.0)) for name in names}
    ).drop("rule_lifts")
