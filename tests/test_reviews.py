import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions.itemsets import split_items
from tidemark.functions.phrases import severity, tag_phrase, with_sentence
from tidemark.functions.reviews import gigabytes, playtime_bucket, round_binary
from tidemark.operators import reviews as R
from tidemark.schemas import DAILY_KPIS, REVIEWS
from tidemark.sources.raw import flatten_reviews, read_review_pages

AS_OF = 996624000
DAY = 86400


def make_reviews(spark, rows):
    """Rows of the reviews table from partial dicts."""
    schema = spark.createDataFrame([], REVIEWS).schema
    names = [f.name for f in schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def make_kpis(spark, rows):
    return spark.createDataFrame(
        [(a, d, 1.0, 1.0, 1, 1, 0.0, trend) for a, d, trend in rows], DAILY_KPIS
    )


@pytest.fixture(scope="module")
def raw_pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    page = {
        "app_id": 7, "cursor": "x", "reviews": [
            {"recommendationid": "1", "review": "fine", "language": "english", "timestamp_created": 10,
             "timestamp_updated": 20, "voted_up": True, "weighted_vote_score": "0.5",
             "author": {"playtime_at_review": 90},
             "hardware": {"os": "Windows 11", "system_ram": 2560, "vram_size": "3584",
                          "screen_width": 1920, "screen_height": 1080}},
            {"recommendationid": 2, "weighted_vote_score": 0.25,
             "hardware": {"system_ram": "x", "vram_size": 0, "screen_width": 0, "screen_height": 5}},
            {"recommendationid": "3", "hardware": {}},
            {"recommendationid": "4"},
        ],
    }
    (folder / "page.json").write_text(json.dumps(page))
    return str(folder)


def test_flatten(spark, raw_pages):
    rows = {r["recommendationid"]: r for r in flatten_reviews(read_review_pages(spark, raw_pages), AS_OF).collect()}
    one, two, three, four = (rows[str(i)] for i in range(1, 5))
    assert (one["hw_ram"], one["hw_vram"], one["hw_resolution"], one["hw_gpu"]) == ("2GB", "4GB", "1920x1080", "Unknown")
    assert (one["weighted_vote_score"], one["playtime_at_review"], one["voted_up"]) == (0.5, 90, True)
    assert (two["hw_ram"], two["hw_vram"], two["hw_resolution"], two["hw_os"]) == ("Unknown",) * 4
    assert two["has_hardware_info"] and two["weighted_vote_score"] == 0.25 and two["timestamp_updated"] == AS_OF
    for empty in (three, four):
        assert not empty["has_hardware_info"]
        assert {empty[c] for c in ("hw_ram", "hw_vram", "hw_os", "hw_gpu", "hw_cpu_vendor", "hw_resolution")} == {"N/A"}
    assert (four["review"], four["language"], four["voted_up"], four["playtime_at_review"]) == ("", "", False, 0)


def test_gigabytes_and_playtime(spark):
    mb = spark.createDataFrame([("2560",), ("3584",), ("0",), ("x",), (None,), ("1536",)], "mb string")
    assert [r[0] for r in mb.select(gigabytes(F.col("mb"))).collect()] == ["2GB", "4GB", "Unknown", "Unknown", "Unknown", "2GB"]
    minutes = [119, 120, 599, 600, 2999, 3000, 11999, 12000]
    labels = spark.createDataFrame([(m,) for m in minutes], "m int").select(playtime_bucket(F.col("m")))
    assert [r[0][len("playtime_"):] for r in labels.collect()] == [
        "refund_zone", "casual", "casual", "mid_core", "mid_core", "heavy", "heavy", "hardcore"
    ]


def test_basket(spark):
    reviews = make_reviews(spark, [dict(
        app_id=1, recommendationid="a", language="", timestamp_updated=AS_OF, voted_up=False, gameplay=4,
        playtime_at_review=5, has_hardware_info=True, hw_ram="Unknown", hw_os="Windows 11", hw_vram="N/A",
    ), dict(app_id=1, recommendationid="b", language="english", timestamp_updated=AS_OF - DAY, has_hardware_info=False,
            hw_os="Windows 11")])
    kpis = make_kpis(spark, [(1, date(2001, 8, 1), "retention_drop"), (2, date(2001, 7, 31), "retention_growth")])
    rows = {r["recommendationid"]: r["items"] for r in R.review_baskets(reviews, kpis).collect()}
    assert rows["a"] == ["gameplay_4", "hw_os_Windows_11", "kpi_retention_drop", "playtime_refund_zone", "voted_up_False"]
    assert rows["b"] == ["lang_english"]


def test_scores(spark):
    def row(i, text, scored):
        return (i, text, json.dumps(scored) if isinstance(scored, dict) else scored)

    reviews = spark.createDataFrame([
        row("ok", "good", {"isSpam": False, "story": 5}),
        row("spam", "good", {"isSpam": True}),
        row("missing", "good", {"story": 5}),
        row("range", "good", {"isSpam": False, "story": 6}),
        row("zero", "good", {"isSpam": False, "story": 0}),
        row("blank", "  ", {"isSpam": False}),
        row("broken", "good", "{oops"),
        row("type", "good", {"isSpam": False, "story": "five"}),
    ], "recommendationid string, review string, scored string")
    kept = R.with_scores(reviews, "scored").collect()
    assert [(r["recommendationid"], r["story"], r["gameplay"]) for r in kept] == [("ok", 5, None)]


def test_sample_keeps_small_days_and_halves_large_ones(spark):
    rows = [(1, "2001-07-01", f"{i:04d}", i / 1000, i) for i in range(300)]
    rows += [(1, "2001-07-02", f"s{i}", 0.5, i) for i in range(250)]
    reviews = spark.createDataFrame(
        rows, "app_id long, day string, recommendationid string, weighted_vote_score double, timestamp_created long"
    )
    kept = R.sample_days(reviews).collect()
    large = {r["recommendationid"] for r in kept if r["day"] == "2001-07-01"}
    assert len(large) == 250 and {f"{i:04d}" for i in range(175, 300)} <= large
    assert sum(r["day"] == "2001-07-02" for r in kept) == 250
    again = {r["recommendationid"] for r in R.sample_days(reviews).collect() if r["day"] == "2001-07-01"}
    assert again == large
    plan = R.sample_days(reviews)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_new_reviews_of_days(spark):
    reviews = spark.createDataFrame(
        [(1, "a", AS_OF - 10), (1, "a", AS_OF - 10), (1, "b", AS_OF - 10), (1, "c", AS_OF - 3 * DAY)],
        "app_id long, recommendationid string, timestamp_created long",
    )
    known = spark.createDataFrame([(1, "b"), (2, "a")], "app_id long, recommendationid string")
    fresh = R.new_reviews_of_days(reviews, known, F.lit("2001-07-31"), F.lit("2001-07-31")).collect()
    assert [(r["recommendationid"], r["day"]) for r in fresh] == [("a", date(2001, 7, 31))]


def test_window_size(spark):
    def at(app, days_back, n, spam=False):
        return [dict(app_id=app, recommendationid=f"{app}-{days_back}-{i}", isSpam=spam,
                     timestamp_updated=AS_OF - days_back * DAY) for i in range(n)]

    rows = at(1, 7, 499) + at(1, 14, 1, spam=True) + at(2, 10, 5) + at(3, 3, 500) + at(4, 200, 600)
    sizes = {r["app_id"]: r["window_days"] for r in R.window_size(make_reviews(spark, rows), AS_OF).collect()}
    assert sizes == {1: 14, 2: 140, 3: 7, 4: 140}


def test_sliding_windows_match_range_predicates(spark):
    offsets = [1, 7 * DAY, 7 * DAY + 1, 14 * DAY, 14 * DAY + 1, 139 * DAY, 140 * DAY, 140 * DAY + 1, 0, -5, 60 * DAY + 3]
    rows = [dict(app_id=1, recommendationid=str(i), isSpam=False, timestamp_updated=AS_OF - o)
            for i, o in enumerate(offsets)]
    rows.append(dict(app_id=1, recommendationid="spam", isSpam=True, timestamp_updated=AS_OF - 1))
    found = {(r["recommendationid"], r["window_no"]) for r in
             R.in_sliding_windows(make_reviews(spark, rows), AS_OF).collect()}
    expected = {
        (str(i), j) for i, o in enumerate(offsets) for j in range(19)
        if AS_OF - j * 7 * DAY - 14 * DAY <= AS_OF - o < AS_OF - j * 7 * DAY
    }
    assert found == expected


def test_rule_filter_one_and_many(spark):
    rows = [dict(app_id=1, recommendationid=str(i), language="english" if i % 2 else "german", gameplay=i % 3 + 1,
                 voted_up=i % 4 == 0, playtime_at_review=i * 100, timestamp_updated=AS_OF - (i % 2) * DAY,
                 has_hardware_info=True, hw_cpu_vendor="x", hw_os="Windows 11" if i % 5 else "Arch Linux") for i in range(60)]
    reviews = make_reviews(spark, rows)
    kpis = make_kpis(spark, [(1, date(2001, 8, 1), "retention_drop"), (1, date(2001, 7, 31), "retention_growth")])
    baskets = R.review_baskets(reviews, kpis)
    cases = [
        ("lang_english", "kpi_retention_growth"), ("gameplay_2 AND playtime_mid_core", "hw_os_Windows_11"),
        ("voted_up_True", "gameplay_1"), ("voted_up_False AND lang_english", "playtime_heavy"), ("lang_klingon", "gameplay_1"),
        ("nonsense_tag AND lang_german", "voted_up_Perhaps"), ("nonsense_tag", "nonsense_too"),
    ]
    rules = spark.createDataFrame([(1, str(i), a, c) for i, (a, c) in enumerate(cases)],
                                  "app_id long, rule_id string, antecedents string, consequents string")
    tagged = R.tagged_reviews(reviews, kpis)
    many = {(r["rule_id"], r["recommendationid"]) for r in R.matching_rules(rules, tagged).collect()}
    counts = {r["rule_id"]: r["matching"] for r in R.matching_rule_counts(rules, tagged).collect()}
    assert counts == {str(i): n for i in range(len(cases)) if (n := sum(rule == str(i) for rule, _ in many))}
    tags = {r["recommendationid"]: set(r["items"]) for r in baskets.collect()}
    for i, (a, c) in enumerate(cases):
        wanted = {t for t in (a + " AND " + c).split(" AND ") if not t.startswith("nonsense") and t != "voted_up_Perhaps"}
        expected = {rid for rid, held in tags.items() if wanted <= held}
        assert {r["recommendationid"] for r in R.matching_rule(reviews, kpis, a, c).collect()} == expected
        assert {rid for rule, rid in many if rule == str(i)} == expected
    assert R.matching_rule(reviews, kpis, None, "").count() == 60
    assert R.matching_rule(reviews, kpis, "nonsense_tag", "gameplay_99x").count() == 60


def test_all_hardware_fields_and_case_of_tags(spark):
    rows = [dict(app_id=1, recommendationid=str(i), has_hardware_info=i > 0, hw_cpu_vendor="Genuine Intel" if i % 2 else "N/A",
                 hw_gpu="Unknown", hw_resolution="1x2", playtime_at_review=130) for i in range(6)]
    reviews, kpis = make_reviews(spark, rows), make_kpis(spark, [])
    cases = [("hw_cpu_vendor_Genuine_Intel", ""), ("hw_cpu_vendor_N/A", "hw_gpu_Unknown"), ("HW_resolution_1x2", "PlayTime_Casual"), ("hw_ram_1GB", "")]
    rules = spark.createDataFrame([(1, str(i), a, c) for i, (a, c) in enumerate(cases)],
                                  "app_id long, rule_id string, antecedents string, consequents string")
    counts = {int(r["rule_id"]): r["matching"] for r in R.matching_rule_counts(rules, R.tagged_reviews(reviews, kpis)).collect()}
    single = {i: n for i, (a, c) in enumerate(cases) if (n := R.matching_rule(reviews, kpis, a, c).count())}
    assert counts == single == {0: 3, 1: 3, 2: 6}


def test_blank_texts_and_every_lookback_step(spark):
    scored = make_reviews(spark, [dict(app_id=1, recommendationid=str(i), review=t, timestamp_updated=AS_OF - 10 * DAY)
                                  for i, t in enumerate(["\n\t ", "", "x", None])])
    answered = scored.drop("isSpam").withColumn("scored", F.lit('{"isSpam": false}'))
    assert [r["recommendationid"] for r in R.with_scores(answered, "scored").collect()] == ["2"]
    counts = {r["days"]: r["reviews"] for r in R.lookback_counts(scored, AS_OF).collect()}
    assert counts == {d: 0 if d < 14 else 4 for d in range(7, 141, 7)}


def test_rule_filter_reaches_the_scan(spark, tmp_path):
    make_reviews(spark, [dict(app_id=1, recommendationid="1", language="english")]).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    matching = R.matching_rule(stored, make_kpis(spark, []), "lang_english AND gameplay_4", "playtime_casual")
    plan = matching._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,english)" in plan and "EqualTo(gameplay,4)" in plan and "LessThan(playtime_at_review,600)" in plan


def test_page(spark):
    rows = [dict(app_id=1, recommendationid=f"{i:03d}", review=f"text {i}", language="english",
                 timestamp_updated=AS_OF - i // 2 * DAY, playtime_at_review=i * 6) for i in range(60)]
    reviews = make_reviews(spark, rows)
    newest = sorted(rows, key=lambda r: (r["timestamp_updated"], r["recommendationid"]), reverse=True)
    page = R.review_page(reviews, 2).collect()
    assert [r["id"] for r in page] == [r["recommendationid"] for r in newest[25:50]]
    each = sorted(R.page_of_each_app(reviews, 3).collect(), key=lambda r: r["position"])
    assert [r["id"] for r in each] == [r["recommendationid"] for r in newest[50:]] and each[0]["total"] == 60
    first = R.review_page(reviews, 1).collect()[0]
    assert (first["date_str"], first["language"], first["has_pillars"], first["voted_up"]) == ("Published 1 Aug", "English", False, False)


def test_split_and_phrases(spark):
    texts = spark.createDataFrame([("a AND b",), ("frozenset({'a', 'b'})",), ("",), (None,), ("'a', \"b\",",)], "t string")
    assert [r[0] for r in texts.select(split_items(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], [], [], ["a", "b"]]
    expected = {
        "gameplay_3": "rated the gameplay 3/5", "monetizationModel_2": "rated the monetization model 2/5",
        "voted_up_False": "left a negative review", "playtime_heavy": "played over 50 hours",
        "playtime_very_long": "played very long", "lang_brazilian": "wrote in Brazilian Portuguese",
        "lang_new_code": "wrote in New Code", "kpi_retention_stable": "joined during a period of stable player numbers",
        "hw_os_Windows_11": "played on Windows 11", "hw_vram_8GB": "had 8GB of VRAM", "hw_gpu_Big_One": "used gpu Big One",
        "voted_up_Maybe": "voted up Maybe", "gameplay_x": "gameplay x",
    }
    tags = spark.createDataFrame([(t,) for t in expected], "t string")
    assert {r[0]: r[1] for r in tags.select("t", tag_phrase(F.col("t"))).collect()} == expected


def test_sentences(spark):
    rules = spark.createDataFrame([
        ("gameplay_3 AND lang_english", "voted_up_True"), ("a_b AND c AND d", ""), ("", ""), (None, None),
    ], "antecedents string, consequents string")
    assert [r["text"] for r in with_sentence(rules).collect()] == [
        "When reviewers rated the gameplay 3/5 and wrote in English, they also left a positive review.",
        "Reviewers who a b, c and d", "All Reviews", "All Reviews",
    ]
    lifts = spark.createDataFrame([(1.5,), (1.49,), (1.2,), (1.0,), (0.9,)], "l double")
    assert [r[0] for r in lifts.select(severity(F.col("l"))).collect()] == ["critical", "warning", "warning", "positive", "neutral"]


def test_rounding_equals_python(spark):
    values = [i / 1000 for i in range(2001)] + [m / 60 for m in range(3000)] + [0.125, 0.375, 2.675, 12345.25, 99999.95]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        found = frame.select("v", round_binary(F.col("v"), digits).alias("r")).collect()
        assert [r["r"] for r in found] == [round(r["v"], digits) for r in found]


def test_tags_of_text_are_those_of_columns(spark):
    """The reading without a job against the reading by columns."""
    from tidemark.functions.itemsets import split_items
    from tidemark.functions.tags import canonical_tag, tags_of_text

    texts = [
        None, "", "  ", "lang_english", "Lang_english AND LANG_French,  kpi_Retention_Growth", "frozenset({'story_05', \"audio_3\"})",
        "frozenset()", "frozenset", "story_99999999999 AND story_4", "story_x", "isUseful_True AND isUseful_true", "hw_os_Windows 11 AND HW_OS_b",
        "playtime_HARDCORE\tAND\nplaytime_unknown", "a AND  AND b", "'lang_de' , ''", "hw_ram_8GB and lang_x", "xlang_de", "lang_", "kpi_", "lang_a\nb",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    read = rows.select("i", F.array_compact(F.transform(split_items(F.col("t")), canonical_tag)).alias("tags")).collect()
    for r in read:
        assert tags_of_text(texts[r["i"]]) == r["tags"], texts[r["i"]]


def test_hardware_spellings_reach_the_scan(spark, tmp_path):
    from tidemark.functions.tags import known_tags

    values = ["Windows 11", "Windows_11", "Windows  11", "Arch Linux x_y", "Arch_Linux_x y", "Mac", "a_b_c_d_e_f_g h"]
    spark.createDataFrame([(v,) for v in values], "hw_os string").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    for tag, found in {"Windows_11": values[:2], "Arch_Linux_x_y": values[3:5], "Mac": ["Mac"], "Windows 11": [], "a_b_c_d_e_f_g_h": values[6:]}.items():
        kept = frame.filter(known_tags(f"hw_os_{tag}")[0].predicate())
        assert sorted(r[0] for r in kept.collect()) == sorted(found)
    assert "PushedFilters: [In(hw_os, [Windows 11,Windows_11])]" in frame.filter(known_tags("hw_os_Windows_11")[0].predicate())._jdf.queryExecution().toString()
