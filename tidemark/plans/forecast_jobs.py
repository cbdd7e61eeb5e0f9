"""Forecasting jobs on the stored tables: matrix, parameters, forecast, export, comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.params import to_json_text
from tidemark.operators import forecast as FC
from tidemark.operators.app_models import benchmark_apps, fit_apps
from tidemark.operators.app_models import forecast_apps as forecast_from
from tidemark.operators.boosting import BoostParams
from tidemark.operators.matrix import daily_matrix
from tidemark.operators.status import params_for_size
from tidemark.operators.search import run_tuning_cycle
from tidemark.operators.tuning import app_sizes, retune_decision
from tidemark.session import cut_lineage
from tidemark.sources.exports import export_forecast
from tidemark.sources.tables import TableStore

FORECAST_DAYS = 45


def stored_matrix(store: TableStore, run_id: str | None = None) -> DataFrame:
    return daily_matrix(
        store.read("daily_kpis"), store.read("reviews"),
        store.read("association_rules"), store.read("mining_runs"), run_id,
    )


def resolve_params(store: TableStore, matrix: DataFrame) -> DataFrame:
    """``app_id, params`` for each app's size, with the fixed parameters where nothing is tuned."""
    sizes = app_sizes(matrix)
    tuned = params_for_size(store.read("hyperparameter_tuning"), sizes)
    return sizes.select("app_id").join(tuned, "app_id", "left").select(
        "app_id", F.coalesce("params", F.lit(to_json_text(BoostParams()))).alias("params")
    )


def ensure_params(
    store: TableStore, matrix: DataFrame, as_of: datetime, n_trials: int = 150, force: bool = False,
    candidates: list[BoostParams] | None = None,
) -> DataFrame:
    """Tunes the apps that need it, then resolves the parameters of all."""
    due = cut_lineage(retune_decision(app_sizes(matrix), store.read("hyperparameter_tuning"), as_of))
    wanted = due if force else due.filter("retune")
    if not wanted.isEmpty():
        run_tuning_cycle(store, matrix, as_of, n_trials, force, candidates, wanted)
    return resolve_params(store, matrix)


def forecast_apps(store: TableStore, as_of: datetime, days: int = FORECAST_DAYS, safety_buffer: float = 1.0) -> DataFrame:
    """Forecasts every app from ``as_of`` on for ``days`` days, with its own model and parameters.

    The newest stored day has no known successor and is no matrix row, so an app's recursion starts before
    ``as_of`` and runs its own gap longer: an app whose data ended long ago adds steps for itself only.
    """
    matrix = cut_lineage(stored_matrix(store))
    today = F.lit(as_of.date())
    horizons = matrix.groupBy("app_id").agg(
        (F.lit(max(1, int(days))) + F.greatest(F.date_diff(today, F.max("date")), F.lit(0))).cast("int").alias("steps"))
    models = fit_apps(matrix, resolve_params(store, matrix))
    return FC.visible_days(forecast_from(matrix, models, safety_buffer=safety_buffer, horizons=horizons), today, days)


def forecast_and_export(store: TableStore, as_of: datetime, root: str, days: int = FORECAST_DAYS) -> str:
    return export_forecast(cut_lineage(forecast_apps(store, as_of, days)), root, as_of)


def compare_tuning(
    matrix: DataFrame, baseline: BoostParams, tuned: BoostParams, split_ratio: float = 0.70, **options
) -> DataFrame:
    """Hold-out metrics before and after tuning, per app and metric."""
    before, _ = benchmark_apps(matrix, baseline, split_ratio, **options)
    after, _ = benchmark_apps(matrix, tuned, split_ratio, **options)
    return FC.metric_deltas(before, after)
