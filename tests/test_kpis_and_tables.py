import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import kpis as K
from tidemark.operators import status as S
from tidemark.schemas import ASSOCIATION_RULES, DAILY_KPIS, HYPERPARAMETER_TUNING, MINING_RUNS
from tidemark.sources import exports as E
from tidemark.sources.tables import TableStore, merge_rows, unseen_rows


def days(spark, rows):
    """``(app, date, mean, peak)`` rows as rows of daily_kpis."""
    return spark.createDataFrame([(a, d, m, m, p, p, 0.0, "t") for a, d, m, p in rows], DAILY_KPIS)


def test_daily_kpis(spark):
    points = [("2001-07-01T10:00:00Z", 4), ("2001-07-01T11:00:00.5Z", 8), ("2001-07-01T23:59:59+00:00", 9),
              ("2001-07-02T00:00:00Z", 11), ("bad", 99)]
    rows = K.daily_kpis(spark.createDataFrame([(1, p, a) for a, p in points], "app_id long, players int, added string"))
    first, second = sorted(rows.collect(), key=lambda r: r["date"])
    assert (first["mean_concurrent"], first["median_concurrent"], first["peak_concurrent"], first["min_concurrent"]) == (7, 8, 9, 4)
    assert (first["pct_change"], first["trend"]) == (0, "retention_stable")
    assert math.isclose(second["pct_change"], 200 / 9) and second["trend"] == "retention_growth"


def test_change_from_zero(spark):
    start = date(2001, 7, 1)
    peaks = [100, 110, 0, 0, 5]
    rows = spark.createDataFrame([(1, start + timedelta(i), p) for i, p in enumerate(peaks)],
                                 "app_id long, date date, peak_concurrent int")
    found = [(round(r["pct_change"], 6), r["trend"][10:]) for r in K.with_trend(rows).orderBy("date").collect()]
    assert found == [(0, "stable"), (10, "growth"), (-100, "drop"), (0, "stable"), (float("inf"), "growth")]
    edges = spark.createDataFrame([(5.0,), (4.99,), (-5.0,), (-4.99,)], "p double")
    assert [r[0][10:] for r in edges.select(K.trend_label(F.col("p"))).collect()] == ["growth", "stable", "drop", "stable"]


def test_missing_days(spark):
    start = date(2001, 1, 1)
    all_days = days(spark, [(1, start + timedelta(i), 1.0, 1) for i in range(200)])
    stored = all_days.filter(F.col("date") > F.lit(start + timedelta(180)))
    new = sorted(r["date"] for r in K.missing_days(all_days, stored).collect())
    assert len(new) == 140 and new[-1] == start + timedelta(180)
    assert K.missing_days(all_days, stored, 7).count() == 7
    assert K.missing_days(all_days, stored, 1000).count() == K.missing_days(all_days, stored, None).count() > 140


def test_merge_and_unseen(spark):
    stored = spark.createDataFrame([(1, "a", "old"), (1, "b", "old")], "app_id long, k string, v string")
    batch = spark.createDataFrame([(1, "b", "x", 1), (1, "c", "x", 2), (1, "c", "y", 1), (2, "a", "x", 1)],
                                  "app_id long, k string, v string, at int")
    fresh = {(r["app_id"], r["k"], r["v"]) for r in unseen_rows(batch, stored, ["app_id", "k"], "at").collect()}
    assert fresh == {(1, "c", "y"), (2, "a", "x")}
    merged = {(r["app_id"], r["k"]): r["v"] for r in merge_rows(stored, batch.filter("v = 'x'"), ["app_id", "k"]).collect()}
    assert merged == {(1, "a"): "old", (1, "b"): "x", (1, "c"): "x", (2, "a"): "x"}


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.read("daily_kpis").isEmpty()
    d1, d2 = date(2001, 7, 1), date(2001, 7, 2)
    store.insert_or_replace("daily_kpis", days(spark, [(1, d1, 1.0, 1), (2, d1, 5.0, 5)]))
    store.insert_or_replace("daily_kpis", days(spark, [(1, d1, 2.0, 2), (1, d2, 3.0, 3)]))
    levels = {(r["app_id"], r["date"]): r["mean_concurrent"] for r in store.read("daily_kpis").collect()}
    assert levels == {(1, d1): 2.0, (1, d2): 3.0, (2, d1): 5.0}

    reviews = spark.createDataFrame([(1, "a", "first"), (1, "b", "first")], "app_id long, recommendationid string, review string")
    store.insert_or_ignore("reviews", reviews)
    store.insert_or_ignore("reviews", reviews.withColumn("review", F.lit("second")).union(
        spark.createDataFrame([(1, "c", "second"), (2, "a", "second")], reviews.schema)))
    stored = {(r["app_id"], r["recommendationid"]): r["review"] for r in store.read("reviews").collect()}
    assert stored == {(1, "a"): "first", (1, "b"): "first", (1, "c"): "second", (2, "a"): "second"}
    scan = store.read("reviews").filter("app_id = 1").select("review")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(app_id" in scan and "ReadSchema: struct<review:string>" in scan

    store.clear("reviews", [1])
    assert [(r["app_id"], r["recommendationid"]) for r in store.read("reviews").collect()] == [(2, "a")]


@pytest.fixture(scope="module")
def rules_and_runs(spark):
    t1, t2 = datetime(2001, 7, 1), datetime(2001, 7, 8)
    runs = spark.createDataFrame(
        [(1, "r1", t1, 14, 500, .02, .5, 1.2, "both"), (1, "r2", t2, 14, 600, .02, .5, 1.2, "both"),
         (2, "r3", t1, 14, 700, .02, .5, 1.2, "both")], MINING_RUNS)
    rules = spark.createDataFrame(
        [(1, f"{run}-{i}", run, f"a{i:02d}", "b", .1, .1, .1, .9, 1.0 + i / 10, .1, 1.0)
         for run in ("r1", "r2") for i in range(20)], ASSOCIATION_RULES)
    return rules, runs


def test_status(spark, rules_and_runs):
    rules, runs = rules_and_runs
    counts = {r["run_id"]: r["total_rules"] for r in S.run_overview(runs, rules).collect()}
    assert counts == {"r1": 20, "r2": 20, "r3": 0}
    assert {r["app_id"]: r["run_id"] for r in S.latest_run(runs).collect()} == {1: "r2", 2: "r3"}
    top = S.top_rules(rules, runs).orderBy("rank").collect()
    assert len(top) == 15 and top[0]["antecedents"] == "a19" and {r["run_id"] for r in top} == {"r2"}
    apps = spark.createDataFrame([(1,), (2,), (3,)], "app_id long")
    assert [r["app_id"] for r in S.needing_initialisation(apps, runs).collect()] == [3]
    due = S.stale_apps(apps, runs, datetime(2001, 7, 8, 12))
    assert {r["app_id"] for r in due.collect()} == {2, 3}
    off = apps.filter("app_id = 3")
    assert {r["app_id"] for r in S.stale_apps(apps, runs, datetime(2001, 7, 10), off).collect()} == {1, 2}


def test_tuning_records(spark):
    now = datetime(2001, 7, 1)
    records = spark.createDataFrame(
        [(1, "x", 140, 300, now, '{"a":1}', 1., 1., 1., 1., 5, 3), (1, "y", 224, 300, now - timedelta(5), '{"a":2}', 1., 1., 1., 1., 5, 3)],
        HYPERPARAMETER_TUNING)

    def chosen(n):
        return S.params_for_size(records, spark.createDataFrame([(1, n)], "app_id long, n_samples int")).first()["tier_size"]

    assert (chosen(300), chosen(224), chosen(223), chosen(100)) == (224, 224, 140, 140)
    assert S.latest_tuning(records).first()["tuning_id"] == "x"


def test_exports(spark, tmp_path, rules_and_runs):
    rules, _ = rules_and_runs
    assert E.export_rules(rules, str(tmp_path / "rules")) == 2
    files = list((tmp_path / "rules").glob("app_id=1/run_id=r2/*.csv"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1 and lines[0].startswith("antecedents,consequents,support") and lines[1].startswith("a19,b")
    forecast = spark.createDataFrame([(1, date(2001, 8, 1), 10.5)], "app_id long, date date, predicted_mean_concurrent double")
    latest = E.export_forecast(forecast, str(tmp_path), datetime(2001, 8, 1, 12))
    read = E.normalise_forecast(spark.read.option("header", True).csv(latest)).first()
    assert (read["day"], read["predicted_mean"]) == ("2001-08-01", 10.5)
    assert (tmp_path / "forecast_20010801_120000").exists()
    E.export_chart(forecast, str(tmp_path / "chart"))
    chart = E.normalise_forecast(spark.read.option("header", True).csv(str(tmp_path / "chart"))).first()
    assert (chart["day"], chart["predicted_mean"]) == ("2001-08-01", 10.5)


def test_review_export_round_trip(spark, tmp_path):
    text = 'two lines\nand "quotes", commas'
    reviews = spark.createDataFrame([(1, "a", text)], "app_id long, recommendationid string, review string")
    E.export_reviews(reviews, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first()["review"] == text


def test_normalise_forecast_names_and_bad_rows(spark):
    raw = spark.createDataFrame([("2001-08-01", "1.5"), ("bad", "2"), ("2001-08-03", "x"), ("2001-08-04", None)], " Date string, KPI string")
    assert [tuple(r) for r in E.normalise_forecast(raw).collect()] == [("2001-08-01", 1.5)]
    assert E.normalise_forecast(spark.createDataFrame([("a",)], "other string")).columns == ["day", "predicted_mean"]
