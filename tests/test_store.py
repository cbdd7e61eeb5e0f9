from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import mining_jobs
from tidemark.sources.tables import TableStore

DAY = 86400


def scanned_rows(df):
    """Rows that the scans of the collected frame handed on, row groups and pages left out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size())]


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), row_group_bytes=4096)


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "app_id long, rule_id string, run_id string")


def ids(store, name="association_rules"):
    return {(r[0], r[1]) for r in store.read(name).select("app_id", "rule_id" if name == "association_rules" else "run_id").collect()}


def test_uncommitted_batches_are_not_read(spark, store, monkeypatch):
    store.append("association_rules", rules(spark, (1, "a", "r"), (2, "b", "r")))
    store.append("mining_runs", spark.createDataFrame([(1, "r"), (2, "r")], "app_id long, run_id string"))
    one = spark.createDataFrame([(1,)], "app_id long")
    new = {"association_rules": rules(spark, (1, "c", "s"), (1, "d", "s")),
           "mining_runs": spark.createDataFrame([(1, "s")], "app_id long, run_id string")}
    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.replace(new, one)
    assert ids(store) == {(1, "a"), (2, "b")} and ids(store, "mining_runs") == {(1, "r"), (2, "r")}
    store.replace(new, one)
    assert ids(store) == {(1, "c"), (1, "d"), (2, "b")} and ids(store, "mining_runs") == {(1, "s"), (2, "r")}


def test_a_remining_job_that_dies_keeps_the_old_runs(spark, store, monkeypatch):
    store.append("association_rules", rules(spark, (1, "a", "r")))
    store.append("mining_runs", spark.createDataFrame([(1, "r")], "app_id long, run_id string"))

    def dies(*_, **__):
        raise RuntimeError("killed")

    monkeypatch.setattr(mining_jobs, "mine", dies)
    with pytest.raises(RuntimeError, match="killed"):
        mining_jobs.remine(store, [1], 40 * DAY)
    assert ids(store) == {(1, "a")} and ids(store, "mining_runs") == {(1, "r")}


def test_replacing_clearing_and_adding_in_turn(spark, store):
    days = "app_id long, date date, mean_concurrent double"
    first = date(2001, 7, 1)
    store.append("daily_kpis", spark.createDataFrame([(1, first, 1.0), (2, first, 2.0), (None, first, 9.0)], days))
    store.insert_or_replace("daily_kpis", spark.createDataFrame([(1, first, 5.0), (3, first, 3.0)], days))

    def found():
        return {r["app_id"]: r["mean_concurrent"] for r in store.read("daily_kpis").collect()}

    assert found() == {1: 5.0, 2: 2.0, 3: 3.0, None: 9.0}
    held = store.read("daily_kpis")
    store.clear("daily_kpis", [1, 4])
    assert found() == {2: 2.0, 3: 3.0, None: 9.0} and held.count() == 4  # a reader's files stay
    store.append("daily_kpis", spark.createDataFrame([(1, first, 7.0)], days))
    store.compact("daily_kpis")
    assert found() == {1: 7.0, 2: 2.0, 3: 3.0, None: 9.0}
    assert store.read("daily_kpis").columns == ["app_id", "date", "mean_concurrent", "median_concurrent", "peak_concurrent",
                                                "min_concurrent", "pct_change", "trend"]


def test_nothing_stored(spark, store):
    assert store.read("reviews").count() == 0
    store.clear("reviews", [1])
    store.insert_or_ignore("reviews", spark.createDataFrame([], "app_id long, recommendationid string"))
    assert store.read("reviews").count() == 0


def test_a_span_of_days_and_a_key_skip_row_groups(spark, store):
    rows = spark.range(20000).select(
        F.lit(1).cast("long").alias("app_id"), F.concat(F.lit("id"), F.xxhash64("id")).alias("recommendationid"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400)) * DAY).cast("int").alias("timestamp_updated"),
        F.lit("text").alias("review"))
    store.append("reviews", rows.repartition(4))
    reviews = spark.read.parquet(f"{store.path('reviews')}")
    some_days = reviews.filter(F.col("timestamp_updated").between(100 * DAY, 113 * DAY)).select("recommendationid")
    (scanned,) = scanned_rows(some_days)
    assert some_days.count() <= scanned < 4000
    wanted = rows.limit(1).collect()[0]["recommendationid"]
    (scanned,) = scanned_rows(reviews.filter(F.col("recommendationid") == wanted).select("review"))
    assert 1 <= scanned < 4000  # the Bloom filters leave one row group, or a few more


def test_reading_an_app_prunes_folders(spark, store):
    now = datetime(2001, 7, 1, tzinfo=UTC).replace(tzinfo=None)
    store.append("mining_runs", spark.createDataFrame([(a, f"r{a}", now) for a in range(8)], "app_id long, run_id string, timestamp timestamp"))
    plan = store.read("mining_runs").filter("app_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "app_id" in plan.split("PartitionFilters", 1)[1]
    store.append("association_rules", rules(spark, (1, "a", "r"), (1, "b", "s")))
    plan = store.read("association_rules").filter("run_id = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in plan.split("PartitionFilters", 1)[1].split("]")[0]
