"""Daily usage indicators from hourly player observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROWTH, DROP, STABLE = "retention_growth", "retention_drop", "retention_stable"
HISTORY_DAYS = 140


def trend_label(pct_change: Column) -> Column:
    return F.when(pct_change >= 5.0, F.lit(GROWTH)).when(pct_change <= -5.0, F.lit(DROP)).otherwise(F.lit(STABLE))


def observation_day(added: Column) -> Column:
    """The UTC day of ISO-8601 text, with or without fractions of a second."""
    return F.to_date(F.try_to_timestamp(added))


def aggregate_days(observations: DataFrame) -> DataFrame:
    """``app_id, date, players`` rows to mean, median, peak and minimum per day."""
    return observations.groupBy("app_id", "date").agg(
        F.avg("players").alias("mean_concurrent"),
        F.median("players").alias("median_concurrent"),
        F.max("players").cast("int").alias("peak_concurrent"),
        F.min("players").cast("int").alias("min_concurrent"),
    )


def with_trend(days: DataFrame) -> DataFrame:
    """Percent change of the daily peak against the previous stored day, and its label.

    From a zero peak the change is infinite when the next peak is positive and 0 otherwise,
    as is the first day of an app.
    """
    previous = F.lag("peak_concurrent").over(Window.partitionBy("app_id").orderBy("date"))
    change = (
        F.when(previous.isNull(), F.lit(0.0))
        .when((previous == 0) & (F.col("peak_concurrent") == 0), F.lit(0.0))
        .when(previous == 0, F.lit(float("inf")))
        .otherwise((F.col("peak_concurrent") / F.nullif(previous, F.lit(0)) - F.lit(1.0)) * F.lit(100.0))
    )
    return days.withColumn("pct_change", change).withColumn("trend", trend_label(F.col("pct_change")))


def daily_kpis(observations: DataFrame) -> DataFrame:
    """``app_id, players, added`` observations to the rows of the ``daily_kpis`` table."""
    dated = observations.select("app_id", "players", observation_day(F.col("added")).alias("date"))
    return with_trend(aggregate_days(dated.filter(F.col("date").isNotNull())))


def missing_days(kpis: DataFrame, stored: DataFrame, max_days: int | None = HISTORY_DAYS) -> DataFrame:
    """Days not stored yet, the newest ``max_days`` per app; all of them with ``None``."""
    fresh = kpis.join(stored.select("app_id", "date"), ["app_id", "date"], "left_anti")
    return fresh if max_days is None else newest_days(fresh, max_days)


def newest_days(days: DataFrame, n: int) -> DataFrame:
    window = Window.partitionBy("app_id").orderBy(F.desc("date"))
    return days.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
