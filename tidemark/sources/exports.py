"""CSV exports, and reading a forecast CSV back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_EXPORT = ["antecedents", "consequents", "support", "confidence", "lift", "leverage", "conviction"]
# Column names under which a forecast CSV may hold its two columns, by preference.
DAY_NAMES = ["day", "date", "timestamp"]
LEVEL_NAMES = ["predicted_mean", "predicted_mean_concurrent", "kpi"]


def export_reviews(reviews: DataFrame, path: str) -> None:
    """All review columns as CSV with a header, one folder per app."""
    (
        reviews.hint("rebalance", "app_id").write.mode("overwrite")
        .option("header", True).option("escape", '"').partitionBy("app_id").csv(path)
    )


def export_rules(rules: DataFrame, path: str) -> int:
    """One CSV folder per run, highest lift first; returns the number of runs exported."""
    (
        rules.select("app_id", "run_id", *RULE_EXPORT)
        .repartition("app_id", "run_id")
        .sortWithinPartitions("app_id", "run_id", F.desc("lift"))
        .write.mode("overwrite").option("header", True).partitionBy("app_id", "run_id").csv(path)
    )
    return rules.select("app_id", "run_id").distinct().count()


def forecast_rows(forecast: DataFrame) -> DataFrame:
    return forecast.select(
        "app_id",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        F.col("predicted_mean_concurrent").alias("predicted_mean"),
    )


def export_forecast(forecast: DataFrame, root: str, as_of: datetime) -> str:
    """Writes a stamped folder, then replaces ``latest`` with the same rows."""
    stamped = f"{root}/forecast_{as_of:%Y%m%d_%H%M%S}"
    forecast_rows(forecast).write.mode("overwrite").option("header", True).partitionBy("app_id").csv(stamped)
    written = forecast.sparkSession.read.schema("day string, predicted_mean double, app_id long").option(
        "header", True).csv(stamped)
    latest = f"{root}/forecast_latest"
    written.write.mode("overwrite").option("header", True).partitionBy("app_id").csv(latest)
    return latest


def export_chart(forecast: DataFrame, path: str) -> None:
    """The chart form: ``timestamp, kpi``."""
    (
        forecast.select(
            "app_id",
            F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.col("predicted_mean_concurrent").alias("kpi"),
        )
        .write.mode("overwrite").option("header", True).partitionBy("app_id").csv(path)
    )


def normalise_forecast(raw: DataFrame) -> DataFrame:
    """``day, predicted_mean`` from any of the known column names; unreadable rows are dropped."""
    trimmed = raw.toDF(*[c.strip().lower() for c in raw.columns])
    day = next((c for c in DAY_NAMES if c in trimmed.columns), None)
    level = next((c for c in LEVEL_NAMES if c in trimmed.columns), None)
    keep = [c for c in ("app_id",) if c in trimmed.columns]
    if day is None or level is None:
        return trimmed.select(
            *keep, F.lit(None).cast("string").alias("day"), F.lit(None).cast("double").alias("predicted_mean")
        ).limit(0)
    parsed = trimmed.select(
        *keep,
        F.date_format(F.col(day).cast("string").try_cast("timestamp"), "yyyy-MM-dd").alias("day"),
        F.col(level).cast("string").try_cast("double").alias("predicted_mean"),
    )
    return parsed.filter(~F.isnan("predicted_mean")).dropna(subset=["day", "predicted_mean"])
