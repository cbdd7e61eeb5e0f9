import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as C
from tidemark.llm.common import small_batches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wanted(rows, min_count, max_words=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang in f:
        found = {p: a for p, a in f[lang].items() if a >= min_count and len(p) > 1}
        held = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                held |= {q for i in range(len(p) - k + 1) if a >= found[q := p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]], n[lang]))
        for i, (score, a, p, l, r, total) in enumerate(sorted(rows)[:top], 1):
            out[lang, i] = (p.decode(), -a, l, r, total, -score)
    return out


def found(frame):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect()}


@pytest.mark.parametrize("range_rows", [1 << 20, 300])
def test_equals_brute_force(documents, range_rows):
    """Many small blocks; one range, and many whose bounds cut phrases."""
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    out = C.collocations(documents.repartition(3), min_count=6, top=150, block_bytes=60_000, range_rows=range_rows)
    assert found(out) == wanted(rows, 6, top=150)


def test_hot_pairs_and_lines(spark):
    """One line in most texts, one pair before ever other words, ties, marks of every kind, overlaps."""
    texts = [f"the same long line again and again, in it w{i % 7} w{i % 5}! in it v{i}\tEnd; x x x x" for i in range(400)]
    rows = [("en" if i % 3 else None, t) for i, t in enumerate(texts)]
    out = C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), min_count=20, block_bytes=900, range_rows=64)
    assert found(out) == wanted(rows, 20)


def test_odd_rows(odd, nothing):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(C.collocations(odd, min_count=2, range_rows=16)) == wanted(rows, 2)
    assert C.collocations(nothing).count() == 0
    assert C.collocations(odd.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_scores_beyond_64_bits(spark):
    big = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in dict(a=9 * 10**15, n=9 * 10**15, l=7 * 10**14, r=3 * 10**15).items()])
    got = big.select(C._scores(*map(F.col, "anlr")).alias("s")).first()["s"]
    assert got == 1000 * (9 * 10**15) ** 2 // (7 * 10**14 * 3 * 10**15)


def test_quicksort_counts_beginnings():
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 4, (500, 4))
    rows[:, 2:] *= rng.integers(0, 2, (500, 1))
    counts = rng.integers(1, 5, 500)
    want = Counter()
    for row, n in zip(rows.tolist(), counts.tolist(), strict=True):
        for k in (2, 3, 4):
            if 0 not in row[:k]:
                want[tuple(row[:k])] += n
    assert dict(C.quicksorted_counts(rows, counts, 30)) == {p: n for p, n in want.items() if n >= 30}


@pytest.fixture
def alike(spark):
    """Suffixes of 200 blocks of much the same words."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(200):
        found = np.unique(rng.integers(1, 1_000_000, (500, 3)).astype(np.int32), axis=0)
        rows.append((f"b{i}", len(found), C._packed(found, np.ones(len(found), np.int64))))
    return spark.createDataFrame(rows, "block string, n long, suffixes binary").repartition(6)


def test_ranges_of_like_blocks_are_even(alike):
    """2,000 sampled suffixes, 10 a block, cut 100,000 into 200 ranges: more than a block's own sample could tell apart."""
    bounds = C.range_bounds(alike, 3, 500, 2_000)
    rows = np.concatenate([C._unpacked(r["suffixes"], 3)[0] for r in alike.collect()])
    rows = rows[np.lexsort(rows.T[::-1])]
    ends = np.array([0, *(C._below(rows, b) for b in bounds), len(rows)])
    assert len(bounds) == 199 and np.diff(ends).max() < 4 * 500


@pytest.mark.parametrize(("n", "most"), [(1, 1), (5, 8), (100, 7), (1000, 999)])
def test_sampled_places(n, most):
    places = C.sampled_places(n, most, np.random.default_rng(3))
    assert len(places) == min(n, most) == len(set(places.tolist())) and 0 <= places.min() and places.max() < n


def test_chunks_of_a_block_are_its_suffixes(spark, documents):
    """Chunks in order, none larger than asked for; phrases do not depend on them."""
    blocks = C.word_blocks(documents, block_bytes=200_000)
    _, numbers = C.frequent_words(blocks, 6)
    numbers = numbers.localCheckpoint()
    tables = [C.suffix_blocks(blocks, numbers, chunk_rows=k) for k in (1 << 30, 700)]
    whole, chunks = ({}, {})
    for table, into in zip(tables, (whole, chunks), strict=True):
        for r in table.collect():
            into.setdefault(r["block"], []).append(C._unpacked(r["suffixes"], C.MAX_WORDS))
            assert r["n"] == len(into[r["block"]][-1][0]) and (table is tables[0] or r["n"] <= 700)
    assert whole.keys() == chunks.keys() and any(len(v) > 1 for v in chunks.values())
    for block, ((rows, counts),) in whole.items():
        parts = sorted(chunks[block], key=lambda x: x[0][0].tolist())
        assert (np.concatenate([p[0] for p in parts]) == rows).all() and (np.concatenate([p[1] for p in parts]) == counts).all()
    a, b = ({tuple(r["key"]): r["n"] for r in C.phrase_counts(t, 6, C.MAX_WORDS, 400).collect()} for t in tables)
    assert a == b and a


def test_more_phrases_than_are_sent_at_once(spark, monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(i, i + 60)) for i in range(0, 600, 30) for _ in range(5)]
    rows = [("en", t) for t in texts]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    monkeypatch.setattr(C, "SENT_ROWS", 3)
    assert found(C.collocations(frame, min_count=5)) == wanted(rows, 5)


def test_small_batches(spark):
    """Python gets rows by the bytes asked for, and the session is left as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("x"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with pytest.raises(ValueError, match="inside"), small_batches(spark):
        found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
        raise ValueError("inside")
    assert len(found) > 2 and max(found) < 2 << 20
    assert spark.conf.get(key) == before
