"""Recursive daily forecasts and their evaluation, for all apps of a pool at once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.boosting import FEATURES, BoostParams, CapacityModel, fit
from tidemark.operators.matrix import EPSILON, PILLAR_FEATURES, calendar
from tidemark.session import cut_lineage

DECAYING = [*PILLAR_FEATURES.values(), "positive_ratio"]
HISTORY = 15
CUT_EVERY = 5
CLIP = 2.0
MIN_ROWS = 10
METRICS = [
    "mae_1step", "rmse_1step", "mape_1step_pct", "mae_multistep", "rmse_multistep", "mape_multistep_pct",
    "mape_multistep_weekday_pct", "mape_multistep_weekend_pct", "underestimation_pct",
    "underestimation_weekend_pct",
]


def baselines(matrix: DataFrame) -> DataFrame:
    """Per app the means of the decaying features; absent rule features count as 0."""
    sizes = matrix.groupBy("app_id").agg(
        F.count("*").alias("n_rows"), *[F.avg(c).alias(f"base_{c}") for c in DECAYING]
    )
    rules = (
        matrix.select("app_id", F.explode("rule_lifts").alias("feature", "lift"))
        .groupBy("app_id", "feature").agg(F.sum("lift").alias("lift"))
        .groupBy("app_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "lift"))).alias("rule_sums"))
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return sizes.join(rules, "app_id", "left").withColumn(
        "base_rules", F.transform_values(F.coalesce("rule_sums", none), lambda _k, v: v / F.col("n_rows"))
    ).drop("rule_sums")


def start_state(matrix: DataFrame, model: CapacityModel) -> DataFrame:
    """One row per app: its newest matrix row, recent levels (newest first) and baselines."""
    newest = Window.partitionBy("app_id").orderBy(F.desc("date"))
    ranked = matrix.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= HISTORY)
    last = ranked.filter("__rn = 1").select("app_id", F.col("date").alias("last_date"), *FEATURES, "rule_lifts")
    recent = ranked.groupBy("app_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rn", "mean_concurrent"))), lambda s: s["mean_concurrent"])
        .alias("levels")
    )
    joined = last.join(recent, "app_id").join(baselines(matrix), "app_id").join(
        model.apps.select("app_id", "app_level", "residual_var"), "app_id"
    )
    lifts = F.transform_values("base_rules", lambda k, _v: F.coalesce(F.try_element_at("rule_lifts", k), F.lit(0.0)))
    path = F.array().cast("array<struct<step:int,date:date,predicted_mean_concurrent:double>>")
    doubles = {c: F.col(c).cast("double") for c in FEATURES}
    return joined.withColumns({**doubles, "rule_lifts": lifts, "path": path, "step": F.lit(0)})


def _decayed(current: Column, base: Column, rate: float) -> Column:
    return current * rate + base * (1.0 - rate)


def recursion(
    model: CapacityModel, safety_buffer: float = 1.0, training_lags: bool = True
) -> Callable[[DataFrame], DataFrame]:
    """The step from one day's state to the next; its columns are built once for all steps."""
    params = model.params
    shift = 1 if training_lags else 0
    ratio = F.greatest(F.least(F.col("prediction"), F.lit(CLIP)), F.lit(-CLIP))
    raw = F.greatest(F.col("mean_concurrent") * F.exp(ratio), F.lit(0.0))
    moved = {
        "step": F.col("step") + 1,
        "raw": raw,
        "levels": F.slice(F.concat(F.array(raw), "levels"), 1, HISTORY),
    }

    def back(days: int) -> Column:
        position = F.least(F.lit(days - 1 + shift), F.size("levels") - 1)
        return F.get("levels", position)

    week = F.slice("levels", 1 + shift, 7)
    day = F.date_add("last_date", F.col("step"))
    corrected = F.col("raw") * F.exp(F.col("step") / 2.0 * F.col("residual_var")) * F.lit(safety_buffer)
    entry = F.struct(
        F.col("step"), day.alias("date"),
        F.greatest(corrected, F.lit(0.0)).alias("predicted_mean_concurrent"),
    )
    previous = F.col("mean_concurrent")
    change = F.coalesce((F.col("raw") - previous) / F.nullif(previous, F.lit(0.0)), F.lit(0.0))
    features = {
        "path": F.concat("path", F.array(entry)),
        "mean_concurrent": F.col("raw"),
        "kpi_lag_1": back(1),
        "kpi_lag_7": back(7),
        "kpi_roll_7_mean": F.aggregate(week, F.lit(0.0), lambda a, v: a + v) / F.size(week),
        "kpi_roll_7_max": F.array_max(week),
        "pct_change": change * (100.0 if training_lags else 1.0),
        **{k: v.cast("double") for k, v in calendar(day).items()},
        **{c: _decayed(F.col(c), F.col(f"base_{c}"), params.decay_rate) for c in DECAYING},
        "rule_lifts": F.transform_values(
            "rule_lifts",
            lambda k, v: _decayed(v, F.try_element_at("base_rules", k), params.rule_decay_rate),
        ),
        **({"kpi_lag_14": back(14)} if training_lags else {}),
    }
    weekend = {"lag7_weekend_interaction": F.col("kpi_lag_7") * F.col("is_weekend")}
    if training_lags:
        boost = F.col("kpi_lag_7") / (F.col("kpi_roll_7_mean") + EPSILON)
        weekend["weekend_boost_ratio"] = boost * F.col("is_weekend")

    def advance(state: DataFrame) -> DataFrame:
        return model.predict(state).withColumns(moved).withColumns(features).withColumns(weekend).drop("raw", "prediction")

    return advance


def forecast_days(
    model: CapacityModel, matrix: DataFrame, days: int | None = 30, safety_buffer: float = 1.0,
    training_lags: bool = True, horizons: DataFrame | None = None,
) -> DataFrame:
    """``app_id, date, predicted_mean_concurrent, step`` for the days after each app's last row.

    Each predicted log-ratio, clipped to ±2, moves the level that the next step starts from. The
    reported value alone is raised by ``exp(step * residual variance / 2)`` and the buffer. With
    ``training_lags`` lags and rolling values keep the meaning they had in training; without, lag 1
    is the current level itself and the remaining features stay as they were. ``horizons`` gives
    ``app_id, steps`` where apps differ; finished apps leave the recursion.
    """
    started = start_state(matrix, model)
    steps = F.lit(days) if horizons is None else F.col("steps")
    state = cut_lineage((started if horizons is None else started.join(horizons, "app_id")).withColumn("steps", steps))
    longest = state.agg(F.max("steps")).first()[0] or 0
    advance = recursion(model, safety_buffer, training_lags)
    done = []
    for step in range(1, longest + 1):
        state = advance(state)
        if step % CUT_EVERY == 0 or step == longest:
            state = cut_lineage(state)
            done.append(state.filter(F.col("steps") <= F.col("step")).select("steps", "app_id", "path"))
            state = state.filter(F.col("steps") > F.col("step"))
    paths = reduce(DataFrame.unionByName, done, state.limit(0).select("steps", "app_id", "path"))
    return paths.select("app_id", "steps", F.explode("path").alias("p")).filter("p.step <= steps").select(
        "app_id", "p.date", "p.predicted_mean_concurrent", "p.step"
    )


def recursive_forecast(
    start: DataFrame, ratio: str, days: int, decaying: tuple[str, ...] = (), decay_rate: float = 0.95, safety_buffer: float = 1.0,
) -> DataFrame:
    """The recursion as one recursive query, for predictors that are SQL expressions of the state.

    ``start`` holds a row per app: ``app_id, last_date, level, residual_var``, the ``decaying`` features and, as
    ``base_<feature>``, what they fall back to. ``ratio`` may use these columns, ``step`` and ``is_weekend`` of the day
    predicted. There is no loop on the driver and no checkpoint; the state never has more than a row per app.
    """
    bases = [f"base_{c}" for c in decaying]
    carried = ", ".join(["app_id", "last_date", "residual_var", *bases])
    features = "".join(f", {c}" for c in decaying)
    moved = "".join(f", {c} * {decay_rate}D + base_{c} * {1.0 - decay_rate}D" for c in decaying)
    next_step = "step + 1"
    weekend = f"CASE WHEN weekday(date_add(last_date, {next_step})) >= 5 THEN 1 ELSE 0 END"
    return start.sparkSession.sql(f"""
        WITH RECURSIVE walk({carried}, step, level{features}) AS (
            SELECT {carried}, 0, CAST(level AS DOUBLE){features} FROM {{start}}
            UNION ALL
            SELECT {carried}, {next_step}, greatest(level * exp(greatest(least({ratio}, {CLIP}D), -{CLIP}D)), 0D){moved}
            FROM (SELECT *, {weekend} AS is_weekend FROM walk WHERE step < {int(days)}))
        SELECT app_id, date_add(last_date, step) AS date, step,
               greatest(level * exp(step * residual_var / 2) * {float(safety_buffer)}D, 0D) AS predicted_mean_concurrent
        FROM walk WHERE step > 0""", start=start)


def visible_days(forecast: DataFrame, as_of: date | Column, days: int) -> DataFrame:
    """Forecast days from ``as_of`` on, the first ``days`` per app."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    order = Window.partitionBy("app_id").orderBy("date")
    return (
        forecast.filter(F.col("date") >= today)
        .withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= days).drop("__rn")
    )


# --- Evaluation -----------------------------------------------------------------------------


def numbered(matrix: DataFrame) -> DataFrame:
    """Adds ``position`` (from 1, oldest first) and ``n_rows`` per app."""
    per_app = Window.partitionBy("app_id")
    return matrix.withColumn("position", F.row_number().over(per_app.orderBy("date"))).withColumn(
        "n_rows", F.count("*").over(per_app)
    )


def forecast_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy per app from ``actual_kpi, pred_1step, pred_multistep, is_weekend`` rows."""
    actual = F.col("actual_kpi")

    def error(prediction: str) -> Column:
        return F.abs(actual - F.col(prediction))

    def percent(prediction: str) -> Column:
        return F.when(actual == 0, F.lit(0.0)).otherwise(error(prediction) / F.nullif(actual, F.lit(0.0)) * 100)

    short = F.greatest((actual - F.col("pred_multistep")) / (actual + EPSILON), F.lit(0.0))
    weekend = F.col("is_weekend") == 1
    multistep = percent("pred_multistep")
    return rows.groupBy("app_id").agg(
        F.count("*").alias("evaluated_days"),
        F.avg(error("pred_1step")).alias("mae_1step"),
        F.sqrt(F.avg(error("pred_1step") ** 2)).alias("rmse_1step"),
        F.avg(percent("pred_1step")).alias("mape_1step_pct"),
        F.avg(error("pred_multistep")).alias("mae_multistep"),
        F.sqrt(F.avg(error("pred_multistep") ** 2)).alias("rmse_multistep"),
        F.avg(multistep).alias("mape_multistep_pct"),
        F.coalesce(F.avg(F.when(~weekend, multistep)), F.avg(multistep)).alias("mape_multistep_weekday_pct"),
        F.coalesce(F.avg(F.when(weekend, multistep)), F.avg(multistep)).alias("mape_multistep_weekend_pct"),
        (F.avg(short) * 100).alias("underestimation_pct"),
        F.coalesce(F.avg(F.when(weekend, short)) * 100, F.lit(0.0)).alias("underestimation_weekend_pct"),
    )


def one_step_levels(model: CapacityModel, rows: DataFrame) -> DataFrame:
    """Adds ``pred_1step``, the predicted next level of each row."""
    ratio = F.greatest(F.least(F.col("prediction"), F.lit(CLIP)), F.lit(-CLIP))
    return model.predict_matrix(rows).withColumn(
        "pred_1step", F.greatest(F.col("mean_concurrent") * F.exp(ratio), F.lit(0.0))
    )


def benchmark_rows(
    train: DataFrame, test: DataFrame, params: BoostParams, eval_days: int | None = None,
    pairing: str = "date", capacity_mode: bool = True, training_lags: bool = True,
) -> DataFrame:
    """Trains on ``train`` and scores the ``position``-ordered ``test`` rows that follow it.

    A test row's actual value is the level of the next day. ``pairing="date"`` compares it with the
    forecast for that same day; ``"shifted"`` pairs the i-th forecast with the i-th test row,
    although that row's actual value lies one day later.
    """
    model = fit(train, params, capacity_mode)
    order = Window.partitionBy("app_id").orderBy("date")
    evaluated = cut_lineage(one_step_levels(model, test).withColumn("step", F.row_number().over(order)))
    if eval_days is not None:
        evaluated = evaluated.filter(F.col("step") <= eval_days)
    last = train.groupBy("app_id").agg(F.max("date").alias("last_date"))
    reach = evaluated.join(last, "app_id").agg(
        F.max("step").alias("steps"), F.max(F.date_diff("target_date", "last_date")).alias("days")
    ).first()
    horizon = reach["days"] if pairing == "date" else reach["steps"]
    forecast = forecast_days(model, train, int(horizon or 0), training_lags=training_lags).select(
        "app_id", F.col("date").alias("target_date"), "step", F.col("predicted_mean_concurrent").alias("pred_multistep")
    )
    key = "target_date" if pairing == "date" else "step"
    paired = evaluated.join(forecast.select("app_id", key, "pred_multistep"), ["app_id", key])
    actual = F.col("target_y_abs")
    return paired.select(
        "app_id", "date", "step",
        actual.alias("actual_kpi"), "pred_1step", F.abs(actual - F.col("pred_1step")).alias("abs_err_1step"),
        "pred_multistep", F.abs(actual - F.col("pred_multistep")).alias("abs_err_multistep"), "is_weekend",
    )


def benchmark(
    matrix: DataFrame, params: BoostParams = BoostParams(), split_ratio: float = 0.70,
    eval_days: int | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """Hold-out evaluation: metrics per app and the day-by-day rows behind them."""
    placed = numbered(matrix).filter(F.col("n_rows") >= MIN_ROWS).withColumn(
        "train_size", F.floor(F.col("n_rows") * F.lit(split_ratio)).cast("int")
    )
    placed = cut_lineage(placed)
    train = placed.filter(F.col("position") <= F.col("train_size")).drop("position", "n_rows", "train_size")
    test = placed.filter(F.col("position") > F.col("train_size")).drop("position", "n_rows", "train_size")
    rows = cut_lineage(benchmark_rows(train, test, params, eval_days, **options))
    sizes = placed.groupBy("app_id").agg(
        F.max("train_size").alias("train_samples"), F.max(F.col("n_rows") - F.col("train_size")).alias("test_samples")
    )
    return sizes.join(forecast_metrics(rows), "app_id"), rows


def metric_deltas(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """Per app and metric: both values, their difference and the improvement in percent."""
    def long(metrics: DataFrame, name: str) -> DataFrame:
        return metrics.select("app_id", *METRICS).unpivot("app_id", METRICS, "metric", name)

    delta = F.col("baseline") - F.col("tuned")
    return long(baseline, "baseline").join(long(tuned, "tuned"), ["app_id", "metric"]).select(
        "app_id", "metric", "baseline", "tuned", delta.alias("delta"),
        F.coalesce(delta / F.nullif(F.col("baseline"), F.lit(0.0)) * 100, F.lit(0.0)).alias("pct_improvement"),
    )
