import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def wanted(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        asked = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in set(terms(text)) if df[t]]
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in asked if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("block_bytes, k, group_terms", [(16 << 20, 50, 200_000), (40_000, 3, 300)])
def test_equals_brute_force(spark, documents, block_bytes, k, group_terms):
    """One block and group; many blocks, several groups and a small k, so that no more accumulators are made early."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    index = L.build_index(documents.repartition(3), block_bytes=block_bytes)
    got = found(L.search(index, items, k, group_terms=group_terms))
    assert got == wanted([(r["doc_id"], r["text"]) for r in documents.collect()], [tuple(r) for r in items.collect()], k)


def test_new_accumulators_stop(documents):
    """With rare terms first the limit is reached before the frequent ones, and results stay exact."""
    rows = documents.select("doc_id", "text").collect()
    made = L.index_block([r["doc_id"] for r in rows], [r["text"] for r in rows]).to_pylist()[0]
    df = {t: e - s for t, s, e in zip(made["terms"], [0, *made["ends"]], made["ends"], strict=False)}
    statistics = L.Statistics(sum(n > 0 for n in made["lengths"]), sum(made["lengths"]), df)
    rare, often = (sorted(df, key=df.get, reverse=r)[:6] for r in (False, True))
    block = L.Block(made, statistics)
    docs, scores = block.best([*rare, *often], 2)
    want = wanted([(r["doc_id"], r["text"]) for r in rows], [(1, " ".join([*rare, *often]))], 2)
    assert [(1, k + 1, int(block.doc_ids[d]), int(s)) for k, (d, s) in enumerate(zip(docs, scores, strict=True))] == want


def test_ties_and_equal_rows(spark):
    docs = spark.createDataFrame([(9, "a b c"), (3, "c B a"), (3, "a b c"), (None, "a b c"), (7, "a b"), (8, None), (5, "!")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b!"), (1, "A b!"), (1, "c"), (2, None), (None, "b zz"), (4, "nowhere")], "item_id long, text string")
    for k in (2, 50):
        got = found(L.search(L.build_index(docs.repartition(4)), items, k))
        assert got == wanted([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], k)


def test_odd_rows(spark, odd, nothing):
    items = odd.select(F.col("extra").alias("item_id"), "text")
    got = found(L.search(L.build_index(odd), items))
    assert got == wanted([(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in items.collect()], 50)
    assert L.search(L.build_index(nothing), items).count() == 0
    assert L.search(L.build_index(odd), items.limit(0)).count() == 0


def test_lengths_beyond_64_bits():
    s = L.Statistics(10**13, 10**16, {})
    import numpy as np
    assert s.norms(np.array([10**8, 3])).tolist() == [50 + 50 * 10**8 * 10**13 // 10**16, 50 + 150 * 10**13 // 10**16]
