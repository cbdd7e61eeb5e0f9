import json
import os
from datetime import date

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators import kpis as K
from tidemark.operators.boosting import BoostParams
from tidemark.plans import cycle, ingest
from tidemark.plans.mining_jobs import MiningParams
from tidemark.schemas import RAW_REVIEW_PAGE
from tidemark.sources.raw import read_player_pages, read_review_pages
from tidemark.sources.tables import TableStore
from tidemark.streaming import ingest as S

AS_OF = 996624000
DAY = 86400


def review_page(app_id, ids, created=AS_OF - 100, text="fine"):
    return {"app_id": app_id, "reviews": [
        {"recommendationid": str(i), "review": text, "language": "english", "timestamp_created": created,
         "timestamp_updated": created, "weighted_vote_score": str(i / 1000)} for i in ids]}


def player_page(app_id, day, hours, base):
    return {"app_id": app_id, "history": [
        {"players": base + h, "added": f"{day}T{h:02d}:30:00{'.25' if h % 2 else ''}Z"} for h in hours]}


def write_pages(folder, name, *pages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(p) for p in pages))


def test_review_stream_restarts_where_it_stopped(spark, tmp_path):
    store, pages, check = TableStore(spark, str(tmp_path / "store")), tmp_path / "pages", str(tmp_path / "check")

    def run():
        S.ingest_reviews(S.review_stream(spark, str(pages), AS_OF), store, check).awaitTermination()
        return {(r["app_id"], r["recommendationid"]): r["review"] for r in store.read("reviews").collect()}

    write_pages(pages, "1.json", review_page(1, [1, 2, 2]), review_page(2, [1]))
    assert set(run()) == {(1, "1"), (1, "2"), (2, "1")}
    write_pages(pages, "2.json", review_page(1, [2, 3], text="later"))
    stored = run()
    assert set(stored) == {(1, "1"), (1, "2"), (1, "3"), (2, "1")} and stored[1, "2"] == "fine"
    # A repeated micro-batch, as after a failure, stores nothing twice.
    S.ingest_reviews(S.review_stream(spark, str(pages), AS_OF), store, check + "2").awaitTermination()
    assert store.read("reviews").count() == 4


def test_kpi_stream_equals_batch_for_closed_days(spark, tmp_path):
    store, pages, check = TableStore(spark, str(tmp_path / "store")), tmp_path / "pages", str(tmp_path / "check")

    def run():
        S.ingest_kpis(S.player_stream(spark, str(pages)), store, check).awaitTermination()
        return {r["date"]: r for r in store.read("daily_kpis").collect()}

    write_pages(pages, "1.json", player_page(1, "2001-07-01", range(24), 100), player_page(1, "2001-07-02", range(12), 200))
    assert set(run()) == {date(2001, 7, 1)}
    write_pages(pages, "2.json", player_page(1, "2001-07-02", range(12, 24), 200), player_page(1, "2001-07-03", range(24), 150))
    first_two = run()
    assert set(first_two) == {date(2001, 7, 1), date(2001, 7, 2)}
    # A late point for a stored day is dropped; the open third day closes with the fourth.
    write_pages(pages, "3.json", player_page(1, "2001-07-01", [5], 9999), player_page(1, "2001-07-04", [3], 1))
    found = run()
    batch = K.daily_kpis(read_player_pages(spark, str(pages / "[12].json")))
    expected = {r["date"]: r for r in batch.collect()}
    assert set(found) == {date(2001, 7, d) for d in (1, 2, 3)}
    for day, row in found.items():
        assert row.asDict() == {**expected[day].asDict(), **{"app_id": 1}}


def test_sliding_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 15 * DAY + 5), (1, 20 * DAY), (2, 29 * DAY), (1, 60 * DAY)], "app_id long, t long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).select("app_id", F.timestamp_seconds("t").alias("at"))
    S.write_available(S.sliding_counts(stream, "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    found = {(r["app_id"], r["s"] // DAY): r["n"] for r in
             spark.read.parquet(str(tmp_path / "out")).withColumn("s", F.unix_timestamp("window_start")).collect()}
    assert found == {(1, 7): 2, (1, 14): 2, (2, 21): 1, (2, 28): 1}


def test_sliding_item_support(spark, tmp_path):
    """Repeats in a basket count once, null and empty baskets in the total only, late windows stay open."""
    rows = spark.createDataFrame(
        [(1, 15 * DAY + 5, ["a", "b", "a"]), (1, 20 * DAY, ["a", None, ""]), (1, 20 * DAY, None), (2, 29 * DAY, []), (1, 60 * DAY, ["z"])],
        "app_id long, t long, items array<string>")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).select("app_id", "items", F.timestamp_seconds("t").alias("at"))
    S.write_available(S.sliding_item_counts(stream, "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    closed = spark.read.parquet(str(tmp_path / "out")).withColumn("s", F.unix_timestamp("window_start") / DAY)
    found = {(r["app_id"], r["s"], r["item"]): (r["n"], r["n_baskets"], r["support"]) for r in S.with_support(closed).collect()}
    assert found == {(1, s, i): (n, 3, n / 3) for s in (7, 14) for i, n in (("a", 2), ("b", 1))}
    assert {(r["app_id"], r["s"]): r["n"] for r in closed.filter("item = ''").collect()} == {(1, 7): 3, (1, 14): 3, (2, 21): 1, (2, 28): 1}


def test_scores_and_why_not(spark):
    rows = [(1, "fine", '{"isSpam": false, "story": 5}'), (2, " \n", '{"isSpam": true}'), (3, None, "x"), (4, "a", "x"), (5, "a", None),
            (6, "a", '{"story": 3}'), (7, "a", '{"isSpam": true, "story": 0}'), (8, "a", '{"isSpam": true, "story": 1}'),
            (9, "a", '{"isSpam": false, "story": "much"}')]
    from tidemark.operators.reviews import checked_scores, with_scores
    frame = spark.createDataFrame(rows, "recommendationid long, review string, scored string")
    found = {r["recommendationid"]: r["reason"] for r in checked_scores(frame, "scored").collect()}
    assert found == {1: None, 2: "blank", 3: "blank", 4: "unreadable", 5: "unreadable", 6: "unstated", 7: "range", 8: "spam", 9: "unreadable"}
    assert [(r["recommendationid"], r["story"]) for r in with_scores(frame, "scored").collect()] == [(1, 5)]


def test_review_update_job(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    pages = tmp_path / "pages"
    write_pages(pages, "1.json", review_page(1, range(300)), review_page(1, [900], AS_OF - 200 * DAY), review_page(1, [901], text=" "))
    raw = read_review_pages(spark, str(pages))
    scores = raw.select("app_id", F.col("raw.recommendationid").alias("recommendationid")).distinct().withColumn(
        "scored", F.when(F.col("recommendationid") == "299", '{"isSpam": true}').otherwise('{"isSpam": false, "story": 4}'))
    outcome = {r["recommendationid"]: r["reason"] for r in ingest.update_reviews(store, raw, scores, AS_OF).collect()}
    assert set(outcome.values()) <= {None, "spam", "blank"} and outcome.get("901", "blank") == "blank"
    stored = {int(r["recommendationid"]) for r in store.read("reviews").collect()}
    assert set(range(176, 299)) <= stored and not {299, 900, 901} & stored
    assert 248 <= len(stored) <= 250
    before = store.read("reviews").count()
    ingest.update_reviews(store, raw.filter("raw.recommendationid in ('200', '201')"), scores, AS_OF)
    assert store.read("reviews").count() == before


def test_daily_cycle(spark, tmp_path):
    store, players, reviews = TableStore(spark, str(tmp_path / "store")), tmp_path / "players", tmp_path / "reviews"
    days = [date.fromordinal(date(2001, 6, 10).toordinal() + i) for i in range(52)]
    write_pages(players, "1.json", *[
        player_page(1, str(d), range(0, 24, 6), 500 + 100 * (d.weekday() >= 5) + i % 3) for i, d in enumerate(days)])
    write_pages(reviews, "1.json", *[review_page(1, range(i * 20, i * 20 + 20), AS_OF - (i + 1) * DAY + 50) for i in range(10)])
    raw = read_review_pages(spark, str(reviews))
    scores = raw.select("app_id", F.col("raw.recommendationid").alias("recommendationid")).withColumn(
        "scored", F.when(F.col("recommendationid").cast("int") % 3 == 0, '{"isSpam": false, "story": 4, "audio": 2}')
        .otherwise('{"isSpam": false, "story": 1, "gameplay": 5}'))
    latest = ingest.daily_cycle(
        store, read_player_pages(spark, str(players)), raw, scores, AS_OF, str(tmp_path / "exports"),
        MiningParams(min_support=0.2, min_reviews=50), kpi_days=None, review_days=None,
        candidates=[BoostParams(n_estimators=2, max_depth=2)], forecast_days=4,
    )
    assert store.read("daily_kpis").count() == 52 and store.read("reviews").count() == 200
    assert store.read("mining_runs").count() == 1 and store.read("association_rules").count() > 0
    assert store.read("hyperparameter_tuning").count() == 1
    rows = spark.read.option("header", True).csv(latest).orderBy("day").collect()
    assert [str(r["day"]) for r in rows] == ["2001-08-01", "2001-08-02", "2001-08-03", "2001-08-04"]


def test_late_rows_over_several_micro_batches(spark, tmp_path):
    """One file a micro-batch: late rows of stored days are kept apart and change nothing; an open day takes its rows in."""
    store, pages, late = TableStore(spark, str(tmp_path / "store")), tmp_path / "pages", str(tmp_path / "late")
    arrivals = [
        [player_page(1, "2001-07-01", range(24), 100)], [player_page(1, "2001-07-02", range(24), 200), player_page(2, "2001-07-02", [23], 7)],
        [player_page(1, "2001-07-01", [5, 6], 9999), player_page(1, "2001-07-02", [3], 300), player_page(1, "2001-07-04", [9], 50)],
        [player_page(1, "2001-07-02", [7], 9999), player_page(2, "2001-07-03", [1], 9999), player_page(1, "2001-07-04", [10], 60)]]
    for i, own in enumerate(arrivals):
        write_pages(pages, f"{i}.json", *own)
        os.utime(pages / f"{i}.json", (1000 + i, 1000 + i))  # the oldest file first

    def run():
        stream = S.player_stream(spark, str(pages), max_files=1)
        S.ingest_kpis(stream, store, str(tmp_path / "check")).awaitTermination()
        S.keep_late(stream, late, str(tmp_path / "late-check")).awaitTermination()
        days = {(r["app_id"], str(r["date"])): r["peak_concurrent"] for r in store.read("daily_kpis").collect()}
        return days, {(r["app_id"], str(r["date"])): r["late"] for r in S.late_counts(spark, late).collect()}

    expected = ({(1, "2001-07-01"): 123, (1, "2001-07-02"): 303, (2, "2001-07-02"): 30},
                {(1, "2001-07-01"): 2, (1, "2001-07-02"): 1, (2, "2001-07-03"): 1})
    assert run() == expected
    assert run() == expected  # nothing new has arrived


def test_a_cycle_goes_on_where_it_stopped(spark, tmp_path):
    ledger, seen = str(tmp_path / "ledger"), []

    def step(name, dies=False):
        def job():
            seen.append(name)
            if dies:
                raise ConnectionError(name)
        return name, job

    with pytest.raises(ConnectionError):
        cycle.run_steps(spark, ledger, "d1", [step("a"), step("b", dies=True), step("c")])
    assert cycle.run_steps(spark, ledger, "d1", [step("a"), step("b"), step("c")]) == ["b", "c"]
    assert cycle.run_steps(spark, ledger, "d1", [step("a"), step("b"), step("c")]) == []
    assert cycle.run_steps(spark, ledger, "d2", [step("a")]) == ["a"]
    assert seen == ["a", "b", "b", "c", "a"]
    assert {(r["cycle"], r["step"]) for r in cycle.finished_steps(spark, ledger).collect()} == {("d1", "a"), ("d1", "b"), ("d1", "c"), ("d2", "a")}


def test_review_stream_that_died_in_a_batch(spark, tmp_path, monkeypatch):
    """The reviews are stored, their batch is lost before its end: the batch repeats and stores nothing twice."""
    store, pages = TableStore(spark, str(tmp_path / "store")), tmp_path / "pages"
    write_pages(pages, "1.json", review_page(1, range(10)), review_page(2, range(3)))
    scores = spark.createDataFrame([(a, str(i), '{"isSpam": %s}' % ("true" if i == 2 else "false")) for a in (1, 2) for i in range(10) if i != 1],
                                   "app_id long, recommendationid string, scored string")
    raw = spark.readStream.schema(RAW_REVIEW_PAGE).json(str(pages))

    def run():
        cycle.ingest_scored_reviews(raw, scores, store, str(tmp_path / "check"), AS_OF - 50).awaitTermination()

    def lost(*args, **kwargs):
        ingest.update_reviews(*args, **kwargs)
        raise ConnectionError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(cycle, "update_reviews", lost)
        with pytest.raises(StreamingQueryException):
            run()
    run()
    stored = sorted((r["app_id"], r["recommendationid"]) for r in store.read("reviews").collect())
    assert stored == [(1, str(i)) for i in range(10) if i not in (1, 2)] + [(2, "0")]
    refused = {(r["app_id"], r["recommendationid"]): r["reason"] for r in cycle.review_outcomes(store).collect() if r["reason"]}
    assert refused == {(1, "1"): "unscored", (1, "2"): "spam", (2, "1"): "unscored", (2, "2"): "spam"}


def test_daily_cycle_by_trigger(spark, tmp_path, monkeypatch):
    """Streams, mining and tuning are done when the forecast fails; the second start only forecasts."""
    store, players, reviews = TableStore(spark, str(tmp_path / "store")), tmp_path / "players", tmp_path / "reviews"
    days = [date.fromordinal(date(2001, 6, 10).toordinal() + i) for i in range(53)]
    write_pages(players, "1.json", *[
        player_page(1, str(d), range(0, 24, 6), 500 + 100 * (d.weekday() >= 5) + i % 3) for i, d in enumerate(days)])
    write_pages(reviews, "1.json", *[review_page(1, range(i * 20, i * 20 + 20), AS_OF - (i + 1) * DAY + 50) for i in range(10)])
    scores = spark.range(200).select(
        F.lit(1).cast("long").alias("app_id"), F.col("id").cast("string").alias("recommendationid"),
        F.when(F.col("id") % 3 == 0, '{"isSpam": false, "story": 4, "audio": 2}').otherwise('{"isSpam": false, "story": 1, "gameplay": 5}').alias("scored"))

    def run():
        return cycle.daily_cycle(
            store, cycle.Inbox(str(players), str(reviews), scores), str(tmp_path / "state"), AS_OF, str(tmp_path / "exports"),
            MiningParams(min_support=0.2, min_reviews=50), review_days=None,
            candidates=[BoostParams(n_estimators=2, max_depth=2)], forecast_days=4)

    def lost(*_):
        raise ConnectionError

    with monkeypatch.context() as patch:
        patch.setattr(cycle, "forecast_and_export", lost)
        with pytest.raises(ConnectionError):
            run()
    assert run() == ["forecast"] and run() == []
    # the newest day is open
    assert store.read("daily_kpis").count() == 52 and store.read("reviews").count() == 200
    assert store.read("mining_runs").count() == 1 and store.read("association_rules").count() > 0
    assert S.late_counts(spark, store.path("late_players")).count() == 0
    steps = [r["step"] for r in cycle.finished_steps(spark, str(tmp_path / "state/ledger")).orderBy("finished").collect()]
    assert steps == ["players", "late players", "reviews", "mining", "tuning", "forecast"]
