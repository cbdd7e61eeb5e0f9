"""The daily cycle by trigger: streams over what has arrived, then the jobs on the store, each step once.

A ledger table names the finished steps of every cycle. A cycle that died is started again with the same name: steps
in the ledger are left out, and the step that died repeats without storing anything twice, as streams go on from their
checkpoint folders and the store ignores known keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans import mining_jobs
from tidemark.plans.forecast_jobs import ensure_params, forecast_and_export, stored_matrix
from tidemark.plans.ingest import update_reviews
from tidemark.schemas import RAW_REVIEW_PAGE
from tidemark.sources.raw import explode_reviews
from tidemark.sources.tables import TableStore
from tidemark.streaming import ingest as S

LEDGER = "cycle string, step string, finished timestamp"
OUTCOMES = "app_id long, recommendationid string, reason string, batch long"


def finished_steps(spark: SparkSession, ledger: str) -> DataFrame:
    """``cycle, step, finished``; no rows before the first step of the first cycle."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def run_steps(spark: SparkSession, ledger: str, cycle: str, steps: Sequence[tuple[str, Callable[[], object]]]) -> list[str]:
    """Runs the steps that the ledger does not name for this cycle, in order, and returns their names."""
    done = {r["step"] for r in finished_steps(spark, ledger).filter(F.col("cycle") == cycle).collect()}
    ran = []
    for name, job in steps:
        if name in done:
            continue
        job()
        row = spark.createDataFrame([(cycle, name)], "cycle string, step string").withColumn("finished", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(ledger)
        ran.append(name)
    return ran


def ingest_scored_reviews(
    pages: DataFrame, scores: DataFrame, store: TableStore, checkpoint: str, as_of: int,
    max_days: int | None = 1, num_reviews: int = 250, top_n: int = 125, seed: int = 42,
) -> StreamingQuery:
    """Arriving review pages through ``update_reviews``; what became of the reviews goes to the table of outcomes.

    Everything that has arrived is one micro-batch, as days are sampled whole.
    """
    root = store.root

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        target = TableStore(batch.sparkSession, root)
        batch.persist()
        outcome = update_reviews(target, explode_reviews(batch), scores, as_of, max_days, num_reviews, top_n, seed)
        outcome.write.mode("overwrite").parquet(f"{target.path('review_outcomes')}/batch={batch_id}")
        batch.unpersist()

    return (
        pages.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def review_outcomes(store: TableStore) -> DataFrame:
    """``app_id, recommendationid, reason`` of all batches; the reason is null for stored reviews."""
    return store.spark.read.schema(OUTCOMES).parquet(store.path("review_outcomes")).drop("batch")


@dataclass(frozen=True)
class Inbox:
    """Folders in which raw pages arrive, and the score answers."""

    players: str
    reviews: str
    scores: DataFrame
    max_files: int | None = None


def ingest_steps(
    store: TableStore, inbox: Inbox, state: str, as_of: int, review_days: int | None = 1,
    num_reviews: int = 250, top_n: int = 125,
) -> list[tuple[str, Callable[[], object]]]:
    """The streams of a cycle: closed days, late rows beside them, reviews. ``state`` holds their checkpoints."""
    spark = store.spark

    def players() -> DataFrame:
        return S.player_stream(spark, inbox.players, inbox.max_files)

    def reviews() -> None:
        pages = spark.readStream.schema(RAW_REVIEW_PAGE).json(inbox.reviews)
        ingest_scored_reviews(
            pages, inbox.scores, store, f"{state}/reviews", as_of, review_days, num_reviews, top_n).awaitTermination()

    return [
        ("players", lambda: S.ingest_kpis(players(), store, f"{state}/players").awaitTermination()),
        ("late players", lambda: S.keep_late(players(), store.path("late_players"), f"{state}/late").awaitTermination()),
        ("reviews", reviews),
    ]


def daily_cycle(
    store: TableStore, inbox: Inbox, state: str, as_of: int, export_root: str,
    params: mining_jobs.MiningParams = mining_jobs.MiningParams(), review_days: int | None = 1,
    n_trials: int = 150, candidates=None, forecast_days: int = 45, skip_tuning: bool = False,
) -> list[str]:
    """Days, reviews, mining, tuning check, forecast. The cycle is named by the day of ``as_of``; returns the steps run."""
    now = datetime.fromtimestamp(as_of, UTC).replace(tzinfo=None)
    steps = ingest_steps(store, inbox, state, as_of, review_days)
    steps.append(("mining", lambda: mining_jobs.run_current(store, as_of, params)))
    if not skip_tuning:
        steps.append(("tuning", lambda: ensure_params(store, stored_matrix(store), now, n_trials, candidates=candidates)))
    steps.append(("forecast", lambda: forecast_and_export(store, now, export_root, forecast_days)))
    return run_steps(store.spark, f"{state}/ledger", str(now.date()), steps)
