import math
import re
from collections import Counter

import pytest

from tidemark.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if often[run] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_base_counts(request, name):
    frame = request.getfixturevalue(name)
    rows = Q.with_counts(frame).select("text", *Q.COUNTS, "base_failed").collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert tuple(r)[1:] == counts(r["text"])


def test_scores_match_brute_force(spark, documents):
    """The model recomputed from the words' hashes, which the engine itself gives."""
    from pyspark.sql import functions as F

    trusted = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1").select("doc_id")
    ids = {r[0] for r in trusted.collect()}
    buckets = documents.select("doc_id", Q.word_hashes(F.col("text")).alias("h")).select(
        "doc_id", Q.ngram_buckets(F.col("h")).alias("b")).collect()
    target, corpus = Counter(), Counter()
    for r in buckets:
        corpus.update(r["b"])
        if r["doc_id"] in ids:
            target.update(r["b"])
    t, c = (sum(x.values()) + Q.BUCKETS for x in (target, corpus))
    wanted = {r["doc_id"]: sum(math.log((target[b] + 1) / t) - math.log((corpus[b] + 1) / c) for b in r["b"]) / len(r["b"])
              for r in buckets}
    found = {r["doc_id"]: r for r in Q.quality_rules(documents, trusted).collect()}
    assert len(found) == len(wanted)
    for doc_id, value in wanted.items():
        assert math.isclose(found[doc_id]["llr"], value, abs_tol=1e-4)
    sound = sorted(found[i]["llr"] for i in ids if not found[i]["base_failed"])
    limit = sound[max(0, math.ceil(Q.QUANTILE * len(sound)) - 1)] - Q.MARGIN
    for r in found.values():
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= limit)


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_rules(docs, labels.filter("quality = 1").select("doc_id")).join(labels, "doc_id").filter("NOT base_failed")
    assert out.filter("quality = 1 AND NOT kept").count() == 0
    junk = out.filter("quality = 0")
    assert junk.filter("kept").count() <= 0.1 * junk.count()


def test_threshold_keeps_junk_out_at_the_stated_loss(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").join(labels, "doc_id", "left_semi").repartition(16)
    trusted = labels.filter("quality = 1 AND toxic = 0").select("doc_id")
    out = Q.quality_rules(docs, trusted).filter("NOT base_failed").select("doc_id", "kept").join(labels, "doc_id").collect()
    good = [r["kept"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in out if r["quality"] == 0]
    assert len(good) - sum(good) <= Q.QUANTILE * len(good)
    assert junk and not any(junk)


def test_threshold_takes_in_trusted_texts_outside_the_sample(spark, documents):
    trusted = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1").select("doc_id")
    found = Q.quality_rules(documents, trusted, trusted_rows=10).join(trusted, "doc_id").filter("NOT base_failed").collect()
    assert len(found) > 20 and all(r["kept"] for r in found)  # a thousandth of so few is none


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long")
    out = Q.quality_rules(odd, none)
    assert out.count() == odd.count() and out.filter("kept <> (NOT base_failed)").count() == 0
    assert dict(out.dtypes)["kept"] == "boolean" and "extra" in out.columns
    some = spark.createDataFrame([(90,), (90,), (None,), (12345,)], "doc_id long")
    out = Q.quality_rules(odd, some)
    assert out.count() == odd.count() and out.filter("text IS NULL AND (kept OR n_words > 0)").count() == 0
    assert Q.quality_rules(nothing, none).count() == 0 and Q.quality_rules(nothing, some).count() == 0


def test_main_path_runs_no_python(spark, documents):
    out = Q.with_counts(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", out)
