"""One model per app, fitted and used in grouped tasks.

An app has at most one matrix row per calendar day, so a group is bounded by the calendar whatever the number of apps, and
thousands of apps, parameter sets or folds are fitted side by side in one job. A model is a row of a table: its trees as
arrays, and the names of just those features that the trees use. Rule features stay the sparse map they are in the matrix;
no list of rule names is made on the driver and no dense column for a rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.params import from_json_text, to_json_text
from tidemark.operators.boosting import FEATURES, INFINITE_CHANGE, BoostParams
from tidemark.operators.forecast import CLIP, DECAYING, HISTORY, MIN_ROWS, forecast_metrics, numbered
from tidemark.operators.matrix import EPSILON
from tidemark.operators.newton import Columns, Trees, fit_trees
from tidemark.session import cut_lineage

MODEL = (
    "app_id long, params string, names array<string>, depth int, feature array<int>, cut array<double>, leaf array<double>, "
    "base double, residual_var double, samples int"
)
USED = [*FEATURES, "rule_lifts", "target_y"]


def with_params(apps: DataFrame, params: BoostParams | DataFrame) -> DataFrame:
    """Adds each app's ``params`` text; a table of ``app_id, params`` need not hold every app."""
    fixed = F.lit(to_json_text(params if isinstance(params, BoostParams) else BoostParams()))
    if isinstance(params, BoostParams):
        return apps.withColumn("params", fixed)
    return apps.join(params.select("app_id", "params"), "app_id", "left").withColumn("params", F.coalesce("params", fixed))


def spread(rows: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Dealt by key for grouped fits: their work is far larger than their bytes, so partitions must not be merged by size."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def dense_values(frame: pd.DataFrame) -> np.ndarray:
    """A row per day; a change from a zero level is a very large number."""
    return np.minimum(frame[FEATURES].to_numpy(dtype=float), INFINITE_CHANGE)


def rule_entries(frame: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(rows, lifts) of each rule feature that the app's days hold."""
    found: dict[str, tuple[list[int], list[float]]] = {}
    for row, lifts in enumerate(frame["rule_lifts"]):
        for name, lift in dict(lifts).items():
            rows, values = found.setdefault(name, ([], []))
            rows.append(row)
            values.append(lift)
    return {name: (np.array(found[name][0]), np.array(found[name][1])) for name in sorted(found)}


def row_weights(frame: pd.DataFrame, peak_weight_alpha: float) -> np.ndarray:
    """Weekends count more, by how far they rise above weekdays."""
    weekend = frame["is_weekend"].to_numpy() == 1
    levels = frame["mean_concurrent"].to_numpy(dtype=float)
    if not weekend.any() or weekend.all():
        return np.ones(len(frame))
    boost = max(0.0, levels[weekend].mean() / (levels[~weekend].mean() + EPSILON) - 1.0)
    return np.where(weekend, 1.0 + peak_weight_alpha * boost, 1.0)


def fit_frame(frame: pd.DataFrame, params: BoostParams, capacity_mode: bool = True) -> tuple[Trees, list[str], float]:
    """(trees over the used features, their names, variance of the residuals) of one app's days."""
    rules = rule_entries(frame)
    y = frame["target_y"].to_numpy(dtype=float)
    trees, fitted = fit_trees(Columns.of(dense_values(frame), list(rules.values())), y,
                              row_weights(frame, params.peak_weight_alpha), params, capacity_mode)
    names = [*FEATURES, *rules]
    used = sorted(set(trees.feature[trees.feature >= 0].tolist()))
    renumbered = np.full(len(names) + 1, -1)
    renumbered[used] = np.arange(len(used))
    trees.feature = renumbered[trees.feature]
    return trees, [names[k] for k in used], float(np.var(y - fitted))


def used_values(frame: pd.DataFrame, names: list[str]) -> np.ndarray:
    """A column per used feature, and one at least."""
    dense, at = dense_values(frame), {name: k for k, name in enumerate(FEATURES)}
    columns = [dense[:, at[n]] if n in at else np.array([dict(lifts).get(n, 0.0) for lifts in frame["rule_lifts"]]) for n in names]
    return np.column_stack(columns) if columns else np.zeros((len(frame), 1))


def _as_row(app_id, text: str, trees: Trees, names: list[str], variance: float, samples: int) -> pd.DataFrame:
    return pd.DataFrame({
        "app_id": [app_id], "params": [text], "names": [names], "depth": [trees.depth], "feature": [trees.feature.ravel().tolist()],
        "cut": [trees.cut.ravel().tolist()], "leaf": [trees.leaf.ravel().tolist()], "base": [trees.base],
        "residual_var": [variance], "samples": [samples]})


def _as_trees(row) -> Trees:
    depth = int(row["depth"])
    inner = (1 << depth) - 1
    return Trees(depth, np.array(row["feature"], int).reshape(-1, inner), np.array(row["cut"], float).reshape(-1, inner),
                 np.array(row["leaf"], float).reshape(-1, inner + 1), float(row["base"]))


def fit_apps(matrix: DataFrame, params: BoostParams | DataFrame = BoostParams(), capacity_mode: bool = True) -> DataFrame:
    """A model per app; apps without rows have none."""
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        text = frame["params"].iloc[0]
        frame = frame.sort_values("date")
        return _as_row(frame["app_id"].iloc[0], text, *fit_frame(frame, from_json_text(text), capacity_mode), len(frame))

    return spread(with_params(matrix.select("app_id", "date", *USED), params)).groupBy("app_id").applyInPandas(fit, MODEL)


def levels_of(frame: pd.DataFrame, predicted: np.ndarray) -> np.ndarray:
    return np.maximum(frame["mean_concurrent"].to_numpy(dtype=float) * np.exp(np.clip(predicted, -CLIP, CLIP)), 0.0)


def predict_apps(matrix: DataFrame, models: DataFrame) -> DataFrame:
    """``app_id, date, target_y, target_y_abs, is_weekend, prediction, pred_1step`` of the rows of apps with a model."""
    def predict(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or model.empty:
            return pd.DataFrame(columns=["app_id", "date", "target_y", "target_y_abs", "is_weekend", "prediction", "pred_1step"])
        row = model.iloc[0]
        predicted = _as_trees(row).predict(used_values(frame, list(row["names"])))
        return frame[["app_id", "date", "target_y", "target_y_abs", "is_weekend"]].assign(
            prediction=predicted, pred_1step=levels_of(frame, predicted))

    rows = matrix.select("app_id", "date", "target_y_abs", *USED)
    return rows.groupBy("app_id").cogroup(models.groupBy("app_id")).applyInPandas(
        predict, "app_id long, date date, target_y double, target_y_abs double, is_weekend int, prediction double, pred_1step double")


def _steps(frame: pd.DataFrame, model, days: int, safety_buffer: float, training_lags: bool) -> Iterator[tuple]:
    """The recursion of one app: (step, day, reported level), from the newest row of ``frame`` on."""
    trees, names, p = _as_trees(model), list(model["names"]), from_json_text(model["params"])
    place = {n: k for k, n in enumerate(names)}
    frame = frame.sort_values("date")
    levels = frame["mean_concurrent"].tolist()[-HISTORY:]
    values = used_values(frame, names)
    now, mean = values[-1], values.mean(axis=0)
    rates = np.array([p.decay_rate if n in DECAYING else 1.0 if n in FEATURES else p.rule_decay_rate for n in names] or [1.0])
    last, shift = frame["date"].iloc[-1], 1 if training_lags else 0
    lag_7 = roll = 0.0
    for step in range(1, days + 1):
        ratio = float(np.clip(trees.predict(now[None, :])[0], -CLIP, CLIP))
        previous, level = levels[-1], max(0.0, levels[-1] * math.exp(ratio))
        day = last + timedelta(step)
        yield step, day, max(0.0, level * math.exp(step / 2.0 * model["residual_var"]) * safety_buffer)
        levels = [*levels, level][-HISTORY:]
        back = levels[: len(levels) - shift] or levels
        week, weekend = back[-7:], int(day.weekday() >= 5)
        lag_7, roll = back[-min(7, len(back))], sum(week) / len(week)
        angle = 2 * math.pi * day.weekday() / 7.0
        moved = {
            "mean_concurrent": level, "kpi_lag_1": back[-1], "kpi_lag_7": lag_7, "kpi_roll_7_mean": roll, "kpi_roll_7_max": max(week),
            "pct_change": ((level - previous) / previous if previous else 0.0) * (100.0 if training_lags else 1.0),
            "dayofweek": day.weekday(), "is_weekend": weekend, "dow_sin": math.sin(angle), "dow_cos": math.cos(angle),
            "lag7_weekend_interaction": lag_7 * weekend,
        }
        if training_lags:
            moved |= {"kpi_lag_14": back[-min(14, len(back))], "weekend_boost_ratio": lag_7 / (roll + EPSILON) * weekend}
        now = now * rates + mean * (1.0 - rates)
        for name in place.keys() & moved.keys():
            now[place[name]] = moved[name]


def forecast_apps(
    matrix: DataFrame, models: DataFrame, days: int = 30, safety_buffer: float = 1.0, training_lags: bool = True,
    horizons: DataFrame | None = None,
) -> DataFrame:
    """``app_id, date, predicted_mean_concurrent, step`` after each app's last row; ``horizons`` has ``app_id, steps``."""
    asked = models.withColumn("steps", F.lit(days)) if horizons is None else models.join(horizons.select("app_id", "steps"), "app_id")

    def forecast(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        found = [] if frame.empty or model.empty else [
            (int(model["app_id"].iloc[0]), day, level, step)
            for step, day, level in _steps(frame, model.iloc[0], int(model["steps"].iloc[0]), safety_buffer, training_lags)]
        return pd.DataFrame(found, columns=["app_id", "date", "predicted_mean_concurrent", "step"])

    return matrix.select("app_id", "date", *USED).groupBy("app_id").cogroup(asked.groupBy("app_id")).applyInPandas(
        forecast, "app_id long, date date, predicted_mean_concurrent double, step int")


# --- Evaluation -----------------------------------------------------------------------------


def split_by_time(matrix: DataFrame, split_ratio: float = 0.70) -> DataFrame:
    """Adds ``position``, ``n_rows`` and ``train_size``; apps with too few rows are left out."""
    return numbered(matrix).filter(F.col("n_rows") >= MIN_ROWS).withColumn(
        "train_size", F.floor(F.col("n_rows") * F.lit(split_ratio)).cast("int"))


def benchmark_apps(
    matrix: DataFrame, params: BoostParams | DataFrame = BoostParams(), split_ratio: float = 0.70,
    eval_days: int | None = None, pairing: str = "date", capacity_mode: bool = True, training_lags: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Hold-out evaluation of every app's own model: metrics per app and the day-by-day rows behind them.

    All test days are scored unless ``eval_days`` says otherwise; each app's recursion runs to its own last one.
    """
    placed = cut_lineage(split_by_time(matrix, split_ratio))
    train = placed.filter(F.col("position") <= F.col("train_size"))
    test = placed.filter(F.col("position") > F.col("train_size"))
    models = cut_lineage(fit_apps(train, params, capacity_mode))
    in_order = Window.partitionBy("app_id").orderBy("date")
    evaluated = predict_apps(test, models).join(test.select("app_id", "date", "target_date"), ["app_id", "date"]).withColumn(
        "step", F.row_number().over(in_order))
    evaluated = cut_lineage(evaluated if eval_days is None else evaluated.filter(F.col("step") <= eval_days))
    last = train.groupBy("app_id").agg(F.max("date").alias("last_date"))
    reach = F.max(F.date_diff("target_date", "last_date")) if pairing == "date" else F.max("step")
    horizons = evaluated.join(last, "app_id").groupBy("app_id").agg(reach.cast("int").alias("steps"))
    forecast = forecast_apps(train, models, training_lags=training_lags, horizons=horizons).select(
        "app_id", F.col("date").alias("target_date"), "step", F.col("predicted_mean_concurrent").alias("pred_multistep"))
    key = "target_date" if pairing == "date" else "step"
    actual = F.col("target_y_abs")
    rows = cut_lineage(evaluated.join(forecast.select("app_id", key, "pred_multistep"), ["app_id", key]).select(
        "app_id", "date", "step", actual.alias("actual_kpi"), "pred_1step", F.abs(actual - F.col("pred_1step")).alias("abs_err_1step"),
        "pred_multistep", F.abs(actual - F.col("pred_multistep")).alias("abs_err_multistep"), "is_weekend"))
    sizes = placed.groupBy("app_id").agg(
        F.max("train_size").alias("train_samples"), F.max(F.col("n_rows") - F.col("train_size")).alias("test_samples"))
    return sizes.join(forecast_metrics(rows), "app_id"), rows
