from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L
from tidemark.llm.common import WHITE, lowered


def brute_force(rows, min_chars=20, min_docs=3):
    """(id, text) rows -> sorted (id, n_lines, n_dropped, kept)."""
    holders = defaultdict(set)
    low = -(2**63)

    def key(line):
        stripped = line.strip(WHITE)
        return lowered(stripped) if len(stripped) >= min_chars else None

    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add(low if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines, own = (text or "").split("\n"), low if doc_id is None else doc_id
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(frame, **settings):
    rows = L.line_dedup(frame, **settings).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted(map(tuple, rows), key=repr)


def test_minimal_perfect_hash_fills_every_slot_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        first, second = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        levels = L.build_hash(first, second)
        assert sorted(L.look_up(levels, first, second)) == list(range(n))


def test_documents_match_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == brute_force(rows)


def test_many_shards_and_salts_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 50)
    monkeypatch.setattr(L, "GROUP_PROBES", 3)
    once = L.line_dedup(documents.filter("doc_id < 80"))
    rows = [tuple(r) for r in documents.filter("doc_id < 80").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in once.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr) == brute_force(rows)


def test_odd_rows(spark, odd, nothing):
    shared = [(i, t, None, None, None) for i, t in [
        (100, "  A line that Many documents share\r\nown"), (101, "a LINE that many documents share"),
        (102, "a line that many documents share\n\ta line that many documents share"), (None, "A line that many documents share")]]
    more = spark.createDataFrame(shared, "doc_id long, text string, lang string, source string, n_chars long")
    frame = odd.unionByName(more, allowMissingColumns=True)
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    assert found(frame) == brute_force(rows)
    assert found(frame, min_chars=1, min_docs=2) == brute_force(rows, 1, 2)
    out = L.line_dedup(frame)
    assert "extra" in out.columns and dict(out.dtypes)["n_lines"] == "bigint"
    assert L.line_dedup(nothing).count() == 0


def test_a_line_of_a_third_of_all_documents(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.concat(F.lit("the very common line of all\nown "), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("a single line of its own, number "), F.col("id").cast("string"))).alias("text"))
    dropped = L.line_dedup(frame).filter("n_dropped = 1")
    assert dropped.count() == 999 and dropped.agg(F.max("doc_id")).first()[0] == 2994
