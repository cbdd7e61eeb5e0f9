import math
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.params import from_json_text, to_json_text
from tidemark.operators import forecast as FC
from tidemark.operators import matrix as X
from tidemark.operators import tuning as T
from tidemark.operators.boosting import BoostParams, app_statistics, fit
from tidemark.plans import forecast_jobs as J
from tidemark.schemas import ASSOCIATION_RULES, DAILY_KPIS, MINING_RUNS, REVIEWS
from tidemark.session import cut_lineage
from tidemark.sources.tables import TableStore

START = date(2001, 1, 1)  # a Monday
QUICK = BoostParams(n_estimators=8, max_depth=3, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0)


def make_kpis(spark, levels):
    """``{app: [level, ...]}``, one level per day from START."""
    rows = [(a, START + timedelta(i), float(v), float(v), int(v), int(v), 0.0, "t")
            for a, values in levels.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, DAILY_KPIS)


def no_reviews(spark):
    return spark.createDataFrame([], REVIEWS)


def weekly(n, base=1000, boost=1.5):
    return [base * (boost if (START + timedelta(i)).weekday() >= 5 else 1) + (i * 37 % 11) for i in range(n)]


@pytest.fixture(scope="module")
def matrix(spark):
    return cut_lineage(X.daily_matrix(make_kpis(spark, {1: weekly(70), 2: weekly(70, 50, 1.2)}), no_reviews(spark)))


def test_matrix_lags_count_rows(spark):
    kpis = make_kpis(spark, {1: [10, 20, 30, 40, 50, 60, 70, 80, 90]}).filter(F.col("date") != F.lit(START + timedelta(2)))
    rows = X.daily_matrix(kpis, no_reviews(spark)).orderBy("date").collect()
    assert [r["mean_concurrent"] for r in rows] == [10, 20, 40, 50, 60, 70, 80]
    assert [r["kpi_lag_1"] for r in rows] == [0, 10, 20, 40, 50, 60, 70]
    assert [r["kpi_lag_7"] for r in rows] == [0] * 7 and rows[2]["daily_review_count"] == 0
    assert rows[3]["kpi_roll_7_mean"] == pytest.approx(70 / 3) and rows[3]["kpi_roll_7_max"] == 40
    assert rows[1]["target_y"] == pytest.approx(math.log(2)) and rows[1]["target_date"] == START + timedelta(3)
    assert [r["dayofweek"] for r in rows[:3]] == [0, 1, 3]


def test_matrix_drops_days_around_zero_levels(spark):
    rows = X.daily_matrix(make_kpis(spark, {1: [5, 0, 5, 6]}), no_reviews(spark)).collect()
    assert [r["date"] for r in rows] == [START + timedelta(2)]


def test_rule_features(spark):
    when = datetime(2001, 1, 2)
    runs = spark.createDataFrame([(1, "r1", when, 14, 1, .1, .1, 1., "both"), (1, "r2", when, 14, 1, .1, .1, 1., "both")], MINING_RUNS)
    rules = spark.createDataFrame([(1, f"{r}{i}", r, "a", c, .1, .1, .1, .5, lift, .1, 1.)
                                   for i, (r, c, lift) in enumerate([("r1", "b", 1.5), ("r2", "b", 2.0), ("r2", "c", 1.2)])], ASSOCIATION_RULES)
    kpis = make_kpis(spark, {1: [5, 6, 7, 8]})
    built = X.daily_matrix(kpis, no_reviews(spark), rules, runs)
    assert X.rule_feature_names(built) == ["rule_lift_a_->b", "rule_lift_a_->c"]
    wide = {r["date"]: r for r in X.with_rule_columns(built, X.rule_feature_names(built)).collect()}
    assert (wide[date(2001, 1, 2)]["rule_lift_a_->b"], wide[date(2001, 1, 2)]["rule_lift_a_->c"]) == (2.0, 1.2)
    assert wide[START]["rule_lift_a_->b"] == 0.0
    one_run = X.daily_matrix(kpis, no_reviews(spark), rules, runs, "r1")
    assert X.rule_feature_names(one_run) == ["rule_lift_a_->b"]


def test_weekend_boost(matrix, spark):
    stats = {r["app_id"]: r for r in app_statistics(matrix).collect()}
    assert stats[1]["natural_boost"] == pytest.approx(0.5, abs=0.02) and stats[2]["natural_boost"] > 0
    falling = X.daily_matrix(make_kpis(spark, {1: weekly(30, 1000, 0.5)}), no_reviews(spark))
    assert app_statistics(falling).first()["natural_boost"] == 0


def test_larger_alpha_underestimates_less(matrix):
    def share_under(alpha):
        model = fit(matrix, replace(QUICK, n_estimators=12, max_depth=2, asymmetric_alpha=alpha))
        return model.predict_matrix(matrix).agg(F.avg((F.col("prediction") < F.col("target_y")).cast("double"))).first()[0]

    assert share_under(15.0) < share_under(1.0)


def test_fit_learns_the_week_and_keeps_its_variance(matrix):
    model = fit(matrix, QUICK)
    scored = model.predict_matrix(matrix)
    error, spread = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("target_y"))), F.avg(F.abs("target_y"))).first()
    assert error < spread / 2
    variances = {r["app_id"]: r["residual_var"] for r in model.apps.collect()}
    check = scored.groupBy("app_id").agg(F.var_pop(F.col("target_y") - F.col("prediction")).alias("v")).collect()
    assert all(variances[r["app_id"]] == pytest.approx(r["v"]) for r in check)
    plain = fit(matrix, QUICK, capacity_mode=False)
    assert plain.predict_matrix(matrix).count() == matrix.count()


def test_unsampled_features_are_never_used(matrix):
    model = fit(matrix, replace(QUICK, n_estimators=3, colsample_bytree=0.1))
    for tree in model.ensemble.trees:
        used = [i for i, v in enumerate(tree.featureImportances.toArray()) if v > 0]
        assert len(used) <= 3


@pytest.mark.parametrize("training_lags", [True, False])
def test_forecast_follows_the_recursion(matrix, training_lags):
    """The Spark recursion against one written out in Python, predictions taken from the same model."""
    model = fit(matrix, QUICK)
    found = FC.forecast_days(model, matrix, 9, 1.1, training_lags).filter("app_id = 1").orderBy("step").collect()
    spark = matrix.sparkSession
    history = [r["mean_concurrent"] for r in matrix.filter("app_id = 1").orderBy("date").collect()]
    row = matrix.filter("app_id = 1").orderBy(F.desc("date")).first().asDict()
    variance = {r["app_id"]: r["residual_var"] for r in model.apps.collect()}[1]
    base = {c: 0.0 for c in FC.DECAYING}
    shift = 1 if training_lags else 0
    for step, got in enumerate(found, 1):
        frame = spark.createDataFrame([row], matrix.schema)
        ratio = max(-2.0, min(2.0, model.predict_matrix(frame).first()["prediction"]))
        level = row["mean_concurrent"] * math.exp(ratio)
        assert got["predicted_mean_concurrent"] == pytest.approx(level * math.exp(step * variance / 2) * 1.1)
        day = matrix.agg(F.max("date")).first()[0] + timedelta(step)
        assert (got["date"], got["step"]) == (day, step)
        previous, history = history[-1], history + [level]
        back = history[:len(history) - shift]
        weekend = int(day.weekday() >= 5)
        row |= {
            "mean_concurrent": level, "kpi_lag_1": back[-1], "kpi_lag_7": back[-7],
            "kpi_roll_7_mean": sum(back[-7:]) / 7, "kpi_roll_7_max": max(back[-7:]),
            "pct_change": (level - previous) / previous * (100 if training_lags else 1),
            "dayofweek": day.weekday(), "is_weekend": weekend,
            "dow_sin": math.sin(2 * math.pi * day.weekday() / 7), "dow_cos": math.cos(2 * math.pi * day.weekday() / 7),
            "lag7_weekend_interaction": back[-7] * weekend, **base,
        }
        if training_lags:
            row |= {"kpi_lag_14": back[-14], "weekend_boost_ratio": back[-7] / (sum(back[-7:]) / 7 + 1e-5) * weekend}


def test_decay_moves_towards_the_baseline(matrix):
    lifted = matrix.withColumn("positive_ratio", F.when(F.col("date") < "2001-02-01", 0.0).otherwise(1.0)).withColumn(
        "rule_lifts", F.when(F.col("date") > "2001-03-01", F.create_map(F.lit("rule_lift_x"), F.lit(2.0))).otherwise(
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    model = fit(lifted, replace(QUICK, n_estimators=1))
    state = FC.start_state(lifted, model)
    first = state.filter("app_id = 1").first()
    after = FC.recursion(model)(state).filter("app_id = 1").first()
    base = first["base_positive_ratio"]
    assert 0 < base < 1 and after["positive_ratio"] == pytest.approx(0.95 + 0.05 * base)
    rule_base = first["base_rules"]["rule_lift_x"]
    assert after["rule_lifts"]["rule_lift_x"] == pytest.approx(2.0 * 0.995 + rule_base * 0.005)


def test_benchmark_pairs_by_date(matrix):
    metrics, rows = FC.benchmark(matrix, QUICK, eval_days=5)
    by_app = {r["app_id"]: r for r in metrics.collect()}
    assert (by_app[1]["train_samples"], by_app[1]["test_samples"]) == (48, 21) and by_app[1]["evaluated_days"] == 5
    levels = {(r["app_id"], r["date"]): r["target_y_abs"] for r in matrix.collect()}
    for r in rows.collect():
        assert r["actual_kpi"] == levels[r["app_id"], r["date"]]
    assert by_app[1]["mape_1step_pct"] < 25
    _, shifted = FC.benchmark(matrix, QUICK, eval_days=5, pairing="shifted")
    late = {(r["app_id"], r["step"]): r["pred_multistep"] for r in rows.collect()}
    for r in shifted.collect():
        if r["step"] > 1:
            assert r["pred_multistep"] == pytest.approx(late[r["app_id"], r["step"] - 1])
    small = matrix.filter(F.col("date") < F.lit(START + timedelta(9)))
    assert FC.numbered(small).filter(F.col("n_rows") >= FC.MIN_ROWS).isEmpty()


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 100., 90., 80., 1), (1, 200., 220., 250., 0), (2, 0., 1., 1., 0)],
                                 "app_id long, actual_kpi double, pred_1step double, pred_multistep double, is_weekend int")
    m = {r["app_id"]: r for r in FC.forecast_metrics(rows).collect()}
    assert m[1]["mae_1step"] == 15 and m[1]["rmse_1step"] == pytest.approx(math.sqrt(250))
    assert m[1]["mape_multistep_pct"] == pytest.approx(22.5)
    assert (m[1]["mape_multistep_weekend_pct"], m[1]["mape_multistep_weekday_pct"]) == (pytest.approx(20), pytest.approx(25))
    assert m[1]["underestimation_pct"] == pytest.approx(10, abs=1e-4)
    assert m[1]["underestimation_weekend_pct"] == pytest.approx(20, abs=1e-4)
    assert (m[2]["mape_1step_pct"], m[2]["underestimation_weekend_pct"], m[2]["mape_multistep_weekend_pct"]) == (0, 0, 0)


# --- Tuning ---------------------------------------------------------------------------------


def tiers_of(spark, n):
    rows = T.size_tiers(spark.createDataFrame([(1, n)], "app_id long, n_samples int")).collect()
    return sorted(r["tier_size"] for r in rows)


def test_tiers(spark):
    def grown(n):
        if n < 140:
            return [n]
        tiers = [140]
        while tiers[-1] * 1.6 < min(n, 5000):
            tiers.append(int(tiers[-1] * 1.6))
        return tiers + [n] if tiers[-1] < n else tiers

    for n in (1, 139, 140, 141, 224, 225, 300, 5000, 9000):
        assert tiers_of(spark, n) == grown(n), n
    assert tiers_of(spark, 300) == [140, 224, 300]


def test_folds(spark):
    frame = T.with_fold_params(spark.createDataFrame([(1, n) for n in (50, 140, 500, 60)], "app_id long, tier_size int"))
    params = {r["tier_size"]: (r["test_size"], r["n_folds"], r["max_trees"]) for r in frame.collect()}
    assert params[140] == (10, 6, 100) and params[500][2] == 250
    for n, (test_size, n_folds, max_trees) in params.items():
        assert T.fold_plan(spark, n)[1] == max_trees
    folds = {}
    for r in T.walk_forward_folds(frame).collect():
        folds.setdefault(r["tier_size"], []).append((r["fold"], r["train_end"], r["test_end"]))
    assert max(folds[140]) == (5, 130, 140)
    for n, (test_size, n_folds, _) in params.items():
        assert [f[1:] for f in sorted(folds.get(n, []))] == T.fold_plan(spark, n)[0]
        assert all(train >= 40 and test - train == test_size for _, train, test in folds.get(n, []))


def test_retune(spark):
    now = datetime(2001, 8, 1)
    sizes = spark.createDataFrame([(1, 10), (2, 211), (3, 210), (4, 100)], "app_id long, n_samples int")
    records = spark.createDataFrame([(2, 140, now), (3, 140, now - timedelta(90, 3600)), (4, 140, now - timedelta(91))],
                                    "app_id long, tier_size int, timestamp timestamp")
    rows = {r["app_id"]: (r["retune"], r["reason"]) for r in T.retune_decision(sizes, records, now).collect()}
    assert [rows[a][0] for a in (1, 2, 3, 4)] == [True, True, False, True]
    assert rows[2][1] == "Current dataset (211 rows) exceeds the max tuned tier (140 rows) by more than 1.5x."
    assert rows[4][1] == "Last tuning was 91 days ago (threshold: 90)."
    assert not {r["app_id"]: r["retune"] for r in T.retune_decision(sizes, records, now, staleness_days=None).collect()}[4]


def test_size_classes():
    """Fifty different sizes are a few searches, each on rows that all its apps have."""
    classes = {T.size_class(n) for n in range(1000, 1050)}
    assert len(classes) <= 2 and all(T.size_class(n) <= n for n in range(1, 6000))
    assert all(T.size_class(n) >= 47 for n in range(47, 6000)) and T.size_class(59) == T.size_class(56)


def test_an_old_app_leaves_the_others_alone(matrix):
    model = fit(matrix, replace(QUICK, n_estimators=2))
    horizons = matrix.sparkSession.createDataFrame([(1, 3), (2, 8)], "app_id long, steps int")
    rows = FC.forecast_days(model, matrix, None, horizons=horizons).collect()
    assert sorted((r["app_id"], r["step"]) for r in rows) == [(1, s) for s in (1, 2, 3)] + [(2, s) for s in range(1, 9)]
    alone = {(r["app_id"], r["step"]): r["predicted_mean_concurrent"] for r in FC.forecast_days(model, matrix, 8).collect()}
    assert all(alone[r["app_id"], r["step"]] == pytest.approx(r["predicted_mean_concurrent"]) for r in rows)


def test_more_than_ten_thousand_rules_are_no_obstacle(spark):
    when = datetime(2001, 1, 2)
    runs = spark.createDataFrame([(1, "r", when, 14, 1, .1, .1, 1., "both")], MINING_RUNS)
    rules = spark.createDataFrame([(1, f"{i}", "r", f"a{i}", "b", .1, .1, .1, .5, 1.5, .1, 1.) for i in range(10_500)], ASSOCIATION_RULES)
    built = X.daily_matrix(make_kpis(spark, {1: [5, 6, 7, 8]}), no_reviews(spark), rules, runs)
    assert len(X.rule_feature_names(built)) == 10_500


def test_candidates_and_json():
    drawn = T.draw_candidates(40, 150)
    assert drawn == T.draw_candidates(40, 150) and len(set(drawn)) == 40
    for c in drawn:
        assert c.n_estimators in (50, 75, 100, 125, 150) and 3 <= c.max_depth <= 6 and 1.5 <= c.asymmetric_alpha <= 15
        assert from_json_text(to_json_text(c)) == c
    assert from_json_text(None) == BoostParams()
    assert from_json_text('{"max_depth": 4, "reg_lambda": 1.0}') == BoostParams(max_depth=4, reg_lambda=1.0)


def test_fold_summary(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0)], "app_id long, v double").select(
        "app_id", *[F.col("v").alias(m) for m in FC.METRICS])
    summary = T.fold_summary(rows).first()
    assert (summary["n_folds"], summary["mae_1step_mean"], summary["mae_1step_std"]) == (2, 2.0, 1.0)


def test_cross_validate(matrix):
    scored = T.cross_validate(matrix, replace(QUICK, n_estimators=2), 69, [(62, 69)], horizon=3).collect()
    assert {r["app_id"] for r in scored} == {1, 2} and all(r["n_folds"] == 1 and r["mape_1step_pct_std"] == 0 for r in scored)


def test_tuning_and_forecast_jobs(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.insert_or_replace("daily_kpis", make_kpis(spark, {1: weekly(60), 2: weekly(57, 50)}))
    matrix = cut_lineage(J.stored_matrix(store))
    now = datetime(2001, 3, 5, 9)
    poor, good = replace(QUICK, n_estimators=1, learning_rate=0.001), replace(QUICK, n_estimators=4)
    params = J.ensure_params(store, matrix, now, candidates=[poor, good])
    assert {from_json_text(r["params"]) for r in params.collect()} == {good}
    history = store.read("hyperparameter_tuning").collect()
    assert {(r["app_id"], r["tier_size"], r["dataset_size_at_tuning"], r["n_trials"]) for r in history} == {(1, 59, 59, 2), (2, 56, 56, 2)}
    assert all(r["tuning_id"].startswith("tune_20010305_090000_") and r["score"] == r["mape_1step_pct"] for r in history)
    J.ensure_params(store, matrix, now + timedelta(1), candidates=[poor])
    assert store.read("hyperparameter_tuning").filter(F.col("timestamp") > F.lit(now)).isEmpty()

    forecast = J.forecast_apps(store, now, days=3).collect()
    assert sorted((r["app_id"], r["date"]) for r in forecast) == [
        (a, now.date() + timedelta(i)) for a in (1, 2) for i in range(3)]
    assert all(r["predicted_mean_concurrent"] >= 0 for r in forecast)
    latest = J.forecast_and_export(store, now, str(tmp_path / "exports"), days=2)
    rows = spark.read.option("header", True).csv(latest)
    assert rows.count() == 4 and set(rows.columns) == {"app_id", "day", "predicted_mean"}
