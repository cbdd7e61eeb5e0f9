import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dups as N
from tidemark.llm.common import lowered


def brute_force(rows, words, percent):
    """(id, text) rows -> sorted (id, n, component, kept)."""
    low = -(2**63)
    rows = [(low if i is None else i, t) for i, t in rows]
    sets = []
    for _, text in rows:
        tokens = lowered(text or "").split()
        n = min(words, len(tokens))
        sets.append({tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set())
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((top(rows[x][0]), top(rows[y][0])))
                parent[b] = a
    none = {low: None}
    return sorted(((none.get(i, i), len(s), none.get(top(i), top(i)), top(i) == i)
                   for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def found(frame, **settings):
    return sorted(map(tuple, N.near_duplicates(frame, **settings).collect()), key=repr)


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_documents(documents, words, percent):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert found(documents, words=words, percent=percent) == brute_force(rows, words, percent)


def test_chains_and_templates(spark):
    """Copies that drift: a bucket's smallest id is far from most members, so stars alone would lose links."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(4):
        words = [word() for _ in range(150)]
        for _ in range(40):
            texts.append(" ".join(words))
            for _ in range(2):
                words[rng.randrange(len(words))] = word()
    template = [word() for _ in range(100)]
    texts += [" ".join(template + [word() for _ in range(12)]) for _ in range(60)]
    rng.shuffle(texts)
    assert found(frame_of(spark, texts), words=3, percent=85) == brute_force(list(enumerate(texts)), 3, 85)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for i in rng.sample(range(120), rng.randrange(0, 6)):
            words[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    assert found(frame_of(spark, texts), words=3, percent=85) == brute_force(list(enumerate(texts)), 3, 85)


def test_odd_rows(odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(odd, words=3, percent=85) == brute_force(rows, 3, 85)
    assert N.near_duplicates(nothing).count() == 0


def test_a_third_are_copies(spark):
    frame = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, "the same words again and again").otherwise(
        F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "abcdefgh"])).alias("text"))
    out = N.near_duplicates(frame)
    assert out.filter("kept").count() == 601 and out.filter("component_id = 1").count() == 300


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    factors, offsets = N._permutations(1024)
    shared = rng.integers(0, 2**64, 800, np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 2**64, 100, np.uint64)])) for _ in range(2)]
    packed = [N.pack_bits(N.minima(s, factors, offsets)) for s in sets]
    words = N._as_words(packed)
    estimate = N.corrected(N.equal_slots(words[:1], words[1:])[0, 0], 1024)
    assert abs(estimate - 0.8) < 0.06
    other = N._as_words([N.pack_bits(N.minima(rng.integers(0, 2**64, 900, np.uint64), factors, offsets))])
    assert abs(N.corrected(N.equal_slots(words[:1], other)[0, 0], 1024)) < 0.06


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in N.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert N.components(links.limit(0)).count() == 0
