"""Incremental ingest on Structured Streaming: reviews, daily indicators, sliding counts.

Every stream takes its checkpoint folder from the caller, below the shared folder; with
``trigger(availableNow=True)`` a run handles what has arrived and ends.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.kpis import with_trend
from tidemark.schemas import RAW_PLAYER_PAGE, RAW_REVIEW_PAGE
from tidemark.sources.raw import explode_players, explode_reviews, flatten_reviews
from tidemark.sources.tables import TableStore

REVIEW_DELAY = "2 days"
KPI_DELAY = "1 hour"


def review_stream(spark: SparkSession, path: str, as_of: int) -> DataFrame:
    """Flattened reviews from arriving pages."""
    pages = spark.readStream.schema(RAW_REVIEW_PAGE).json(path)
    return flatten_reviews(explode_reviews(pages), as_of)


def without_repeats(reviews: DataFrame, delay: str = REVIEW_DELAY) -> DataFrame:
    """Drops ids seen within the delay; the state of older ids is released."""
    timed = reviews.withColumn("event_time", F.timestamp_seconds("timestamp_updated"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["app_id", "recommendationid"])


def ingest_reviews(reviews: DataFrame, store: TableStore, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through insert-or-ignore, so a repeated batch stores nothing twice.

    The store decides what is new; no watermark does, so reviews that arrive late are kept.
    """
    def store_batch(batch: DataFrame, _batch_id: int) -> None:
        batch.persist()  # read twice below
        TableStore(batch.sparkSession, store.root).insert_or_ignore("reviews", batch)
        batch.unpersist()

    return (
        reviews.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def player_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``app_id, players, ts`` from arriving pages of player history, ``max_files`` of them at once, the oldest first."""
    reader = spark.readStream.schema(RAW_PLAYER_PAGE)
    pages = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).json(path)
    return explode_players(pages).select("app_id", "players", F.try_to_timestamp("added").alias("ts"))


def closed_days(observations: DataFrame, delay: str = KPI_DELAY) -> DataFrame:
    """Daily aggregates, emitted once the watermark has passed the day; later rows are dropped."""
    return (
        observations.withWatermark("ts", delay)
        .groupBy("app_id", F.window("ts", "1 day").alias("w"))
        .agg(
            F.avg("players").alias("mean_concurrent"),
            F.median("players").alias("median_concurrent"),
            F.max("players").cast("int").alias("peak_concurrent"),
            F.min("players").cast("int").alias("min_concurrent"),
        )
        .select(
            "app_id", F.to_date("w.start").alias("date"),
            "mean_concurrent", "median_concurrent", "peak_concurrent", "min_concurrent",
        )
    )


def ingest_kpis(observations: DataFrame, store: TableStore, checkpoint: str) -> StreamingQuery:
    """Appends closed days; a day that is stored is never revised.

    A row is late if the batches before its own closed its day. Left to itself Spark lags by one more batch, for the sake
    of several stateful operators in a row, which this stream has not.

    The change against the previous day spans batches, so a batch is joined by the newest stored
    day of each of its apps before the trend is computed.
    """
    def store_batch(batch: DataFrame, _batch_id: int) -> None:
        batch.persist()
        target = TableStore(batch.sparkSession, store.root)
        columns = ["app_id", "date", "mean_concurrent", "median_concurrent", "peak_concurrent", "min_concurrent"]
        stored = target.read("daily_kpis").join(batch.select("app_id").distinct(), "app_id", "left_semi")
        newest = stored.groupBy("app_id").agg(F.max(F.struct(*columns[1:])).alias("d")).select("app_id", "d.*")
        fresh = batch.select(*columns).join(stored.select("app_id", "date"), ["app_id", "date"], "left_anti")
        timed = with_trend(newest.unionByName(fresh))
        new = timed.join(stored.select("app_id", "date"), ["app_id", "date"], "left_anti")
        target.append("daily_kpis", new)
        batch.unpersist()

    conf, setting = observations.sparkSession.conf, "spark.sql.streaming.statefulOperator.allowMultiple"
    before = conf.get(setting)
    conf.set(setting, "false")  # a query keeps the settings it started with
    try:
        return (
            closed_days(observations).writeStream.outputMode("append").foreachBatch(store_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        conf.set(setting, before)


def keep_late(observations: DataFrame, folder: str, checkpoint: str, delay: timedelta = timedelta(hours=1)) -> StreamingQuery:
    """Writes the rows that ``ingest_kpis`` drops: those of days which the watermark had passed before they arrived.

    The stream must have the source options of the one that closes days, so that both see the same micro-batches. A
    batch is late by the latest time of the batches before it, which are kept in ``folder/marks``. Both folders are
    written by batch number, so a repeated batch writes the same rows again. Rows without a time are never late.
    """
    def store_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        latest = batch.agg(F.max("ts").alias("latest"))
        latest.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")
        marks = spark.read.schema("latest timestamp, batch long").parquet(f"{folder}/marks")
        mark = marks.filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        closed = F.lit(False) if mark is None else F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") <= F.lit(mark - delay)
        late = batch.filter(closed).write.mode("overwrite")
        late.parquet(f"{folder}/rows/batch={batch_id}")
        batch.unpersist()

    return (
        observations.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``app_id, date, late``: how many rows of each stored day came too late."""
    rows = spark.read.schema("app_id long, players int, ts timestamp, batch long").parquet(f"{folder}/rows")
    return rows.groupBy("app_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("late"))


def sliding_counts(rows: DataFrame, time: str, delay: str, window_days: int = 14, step_days: int = 7,
                   start: str = "0 seconds") -> DataFrame:
    """Rows per app and sliding window; append mode emits a window once it is closed."""
    return (
        rows.withWatermark(time, delay)
        .groupBy("app_id", F.window(time, f"{window_days} days", f"{step_days} days", start).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("app_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


TOTAL = ""


def sliding_item_counts(baskets: DataFrame, time: str, delay: str, window_days: int = 14, step_days: int = 7) -> DataFrame:
    """``app_id, window_start, window_end, item, n`` per app, sliding window and item of ``items``, for closed windows.

    The empty item counts the window's baskets: it is in the same state as the items, so it closes with them and
    ``with_support`` needs no second stream. An item counts once a basket; a null or empty basket counts in the total.
    """
    items = F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))
    known = F.filter(items, lambda i: i.isNotNull() & (i != TOTAL))
    rows = baskets.withColumn("item", F.explode(F.concat(known, F.array(F.lit(TOTAL)))))
    return (
        rows.withWatermark(time, delay)
        .groupBy("app_id", F.window(time, f"{window_days} days", f"{step_days} days").alias("w"), "item")
        .agg(F.count("*").alias("n"))
        .select("app_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item", "n")
    )


def with_support(counts: DataFrame) -> DataFrame:
    """The items of closed windows with ``n_baskets`` of their window and ``support``."""
    key = ["app_id", "window_start", "window_end"]
    totals = counts.filter(F.col("item") == TOTAL).select(*key, F.col("n").alias("n_baskets"))
    return counts.filter(F.col("item") != TOTAL).join(totals, key).withColumn("support", F.col("n") / F.col("n_baskets"))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over everything that has arrived into a Parquet folder."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
