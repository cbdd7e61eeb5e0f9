import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_lm as M
from tidemark.llm import queries as Q
from tidemark.llm.common import lowered

END = "end"


def tokens(text):
    return [*lowered(text or "").split(), END]


class BruteForce:
    def __init__(self, texts):
        docs = [tokens(t) for t in texts]
        self.counts = Counter(w for d in docs for w in d)
        self.pairs = Counter(p for d in docs for p in zip(d, d[1:], strict=False))
        self.total, self.size = sum(self.counts.values()), len(self.counts)
        self.followers = Counter(a for a, _ in self.pairs)

    def single(self, w):
        return (self.counts[w] + 0.5) / (self.total + 0.5 * (self.size + 1))

    def score(self, text):
        doc, base, model = tokens(text), 0.0, 0.0
        for i, w in enumerate(doc):
            p = self.single(w)
            base += math.log10(p)
            if i and self.followers[doc[i - 1]]:
                c, u = self.counts[doc[i - 1]], doc[i - 1]
                p = max(self.pairs[u, w] - M.DISCOUNT, 0) / c + M.DISCOUNT * self.followers[u] / c * p
            model += math.log10(p)
        return len(doc), sum(self.counts[w] > 0 for w in doc), base, model


def assert_equal(rows, brute):
    for r in rows:
        n, known, base, model = brute.score(r["text"])
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], model, rel_tol=1e-3, abs_tol=1e-3)  # coded probabilities


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    for universe in (n, 10 * n, 2**40, 2**63):
        values = np.sort(rng.integers(0, universe, n, np.uint64))
        code = M.EliasFano(M.elias_fano(values, universe))
        assert (code.access(np.arange(n)) == values).all()
        places = code.find(values)
        assert (values[places] == values).all()
        absent = np.setdiff1d(rng.integers(0, universe, 200, np.uint64), values)
        assert (code.find(absent) == -1).all()


def test_small_files_and_split_contexts(spark, documents):
    """Files of a few tokens: contexts are cut over several files, and every count is still found."""
    docs = documents.filter("doc_id < 60")
    learn, test = docs.filter("doc_id % 3 > 0"), docs
    trie = M.train(learn, file_words=64, file_tokens=200)
    assert len(trie.vocabulary.files) > 8 and len(trie.pairs) > 30
    rows = M.score(test, trie).collect()
    assert len(rows) == docs.count()
    assert_equal(rows, BruteForce([r["text"] for r in learn.collect()]))


def test_query_learns_from_the_other_folds(spark, documents):
    rows = Q.op9_ngram_lm(spark, "/root/testdata/sf0.001").join(documents.select("doc_id", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    brute = BruteForce([r["text"] for r in rows if not r["held_out"]])
    assert {r["train_tokens"] for r in rows} == {brute.total}
    assert_equal(rows, brute)


def test_held_out_texts_score_better_than_by_single_words(spark):
    rows = Q.op9_ngram_lm(spark, "/root/testdata/sf0.01").filter("held_out")
    sums = rows.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]


def test_odd_rows(odd, nothing):
    rows = M.score(odd, M.train(odd)).collect()
    assert len(rows) == odd.count() and "extra" in rows[0].asDict()
    assert_equal(rows, BruteForce([r["text"] for r in rows]))
    empty = M.train(nothing)
    assert empty.vocabulary.total == 0
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in M.score(odd, empty).collect())
    assert M.score(nothing, empty).count() == 0
