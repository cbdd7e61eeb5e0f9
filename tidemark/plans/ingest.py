"""Update jobs: saved raw pages into the stored tables, and one daily cycle."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import kpis as K
from tidemark.operators import reviews as R
from tidemark.plans import mining_jobs
from tidemark.plans.forecast_jobs import ensure_params, forecast_and_export, stored_matrix
from tidemark.session import cut_lineage
from tidemark.sources.raw import flatten_reviews
from tidemark.sources.tables import TableStore

DAY = 86400


def update_kpis(store: TableStore, observations: DataFrame, max_days: int | None = K.HISTORY_DAYS) -> None:
    """Adds the days that are not stored yet, the newest ``max_days`` per app, or all with ``None``."""
    days = K.daily_kpis(observations)
    store.insert_or_replace("daily_kpis", K.missing_days(days, store.read("daily_kpis"), max_days))


def update_reviews(
    store: TableStore, raw: DataFrame, scores: DataFrame, as_of: int, max_days: int | None = R.MAX_LOOKBACK_DAYS,
    num_reviews: int = 250, top_n: int = 125, seed: int = 42,
) -> DataFrame:
    """Flattens, drops known ids, samples each of the last ``max_days`` days (all days with ``None``), attaches the
    scores and stores the result.

    ``scores`` holds ``app_id, recommendationid, scored`` with the score answer as JSON text. Returns what became of the
    sampled reviews: ``app_id, recommendationid, reason``, the reason being ``unscored`` (no answer at all), one of
    ``checked_scores``, or null where the review was stored. Sampling and checking happen once, for both.
    """
    last = datetime.fromtimestamp(as_of, UTC).date()
    flat = flatten_reviews(raw, as_of)
    first = F.lit("0001-01-01").cast("date") if max_days is None else F.date_sub(F.lit(last), max_days - 1)
    fresh = R.new_reviews_of_days(flat, store.read("reviews"), first, F.lit(last))
    sampled = R.sample_days(fresh, num_reviews, top_n, seed)
    answered = scores.select("app_id", "recommendationid", "scored", F.lit(True).alias("__answered"))
    checked = R.checked_scores(sampled.join(answered, ["app_id", "recommendationid"], "left"), "scored")
    checked = cut_lineage(checked.withColumn("reason", F.when(F.col("__answered").isNull(), "unscored").otherwise(F.col("reason"))))
    store.insert_or_ignore("reviews", checked.filter(F.col("reason").isNull()).drop("reason", "__answered"))
    return checked.select("app_id", "recommendationid", "reason")


def daily_cycle(
    store: TableStore, observations: DataFrame, raw: DataFrame, scores: DataFrame, as_of: int, export_root: str,
    params: mining_jobs.MiningParams = mining_jobs.MiningParams(), kpi_days: int | None = 7,
    review_days: int | None = 1, n_trials: int = 150, candidates=None, forecast_days: int = 45,
    skip_tuning: bool = False,
) -> str:
    """KPIs, reviews, mining, tuning check, forecast; the initial load is the same with no day limits."""
    now = datetime.fromtimestamp(as_of, UTC).replace(tzinfo=None)
    update_kpis(store, observations, kpi_days)
    update_reviews(store, raw, scores, as_of, review_days)
    mining_jobs.run_current(store, as_of, params)
    if not skip_tuning:
        ensure_params(store, stored_matrix(store), now, n_trials, candidates=candidates)
    return forecast_and_export(store, now, export_root, forecast_days)
