"""Ranked lexical search: term-at-a-time over an index of document blocks, with a limit on new accumulators.

The index has a row per block of documents: the block's distinct terms in order, and per term its documents and their
term counts. It knows nothing of any query, so it is built once. A search makes two passes over it. The first adds up the
documents that hold each asked term; the second ranks each block by itself, all items of a group at once, and returns
the block's best ``k`` documents per item, from which the best ``k`` of all are taken.

Inside a block an item's terms are taken rarest first. While a document that has no accumulator could still reach the
``k``-th best partial score (what the remaining terms can add at most is known from their largest part in the block),
terms create accumulators. After that they only update those that exist, which stay exact: a document without one can no
longer be among the best ``k``. Documents of equal score at the limit are never lost, as the bound must be smaller.

Items are asked in groups of about ``GROUP_TERMS`` terms, so what goes to the workers is bounded; more items are more
groups, each with two passes.

Defined results: a null text, document or item, has no terms; a document without terms counts in nothing and is never
found, an item without known terms finds nothing. Repeated document rows are documents each; of repeated items (id and
text) one stays, and items that share an id with different texts are ranked each by itself. A null ``doc_id`` comes last
among equal scores. Only id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, written

TOP = 50
#: Bytes of text in a block of the index; terms of the items that are asked together, on average.
BLOCK_BYTES, GROUP_TERMS = 16 << 20, 200_000
#: Fixed values of the score.
SCALE, TERM_SCALE, LENGTH_SHARE = 1_000_000_000, 1_000, 50
#: ASCII letters and digits and everything beyond ASCII are in terms; A-Z are lower-cased.
_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_OTHER + UPPER.encode(), b" " * len(_OTHER) + LOWER.encode())
INDEX = "doc_ids array<long>, lengths array<long>, terms array<string>, ends array<long>, docs binary, counts binary"
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _list(values, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def index_block(doc_ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths, found = [], []
    for text in texts:
        own = terms_of(text)
        lengths.append(len(own))
        found.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    terms = list(numbers)
    order = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    n = max(1, len(texts))
    pairs, counts = np.unique(
        np.concatenate([rank[own] * n + doc for doc, own in enumerate(found)] or [np.zeros(0, np.int64)]), return_counts=True)
    ends = np.cumsum(np.bincount(pairs // n, minlength=len(terms)))
    press = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays(
        [_list(doc_ids, pa.int64()), _list(lengths, pa.int64()),
         _list([terms[k] for k in order], pa.binary()).cast(pa.list_(pa.string())), _list(ends, pa.int64()),
         pa.array([press.compress((pairs % n).astype("<u4").tobytes())]), pa.array([press.compress(counts.astype("<u4").tobytes())])],
        names=["doc_ids", "lengths", "terms", "ends", "docs", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index as a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text, n in zip(*(batch.column(c).to_pylist() for c in ("id", "text")),
                                       pc.binary_length(batch.column("text")).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += n
                if size >= block_bytes:
                    yield index_block(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield index_block(ids, texts)

    return written(rows.mapInArrow(run, INDEX), "lexical-index")


# --- Ranking of a block -------------------------------------------------------------------------


@dataclass
class Statistics:
    """``n_docs`` documents with terms, ``n_terms`` terms of all, and the documents that hold each asked term."""

    n_docs: int
    n_terms: int
    df: dict[str, int]

    def weight(self, term: str) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * self.df[term] + 1)))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """m of each document; whole numbers beyond 64 bits where the product needs them."""
        if not self.n_terms:
            return np.zeros(len(lengths), np.int64)
        if len(lengths) and LENGTH_SHARE * self.n_docs * int(lengths.max()) > NO_ID:
            parts = [LENGTH_SHARE * int(n) * self.n_docs // self.n_terms for n in lengths]
        else:
            parts = LENGTH_SHARE * lengths * self.n_docs // self.n_terms
        return 100 - LENGTH_SHARE + np.asarray(parts, np.int64)


class Block:
    """One row of the index, with the parts of the scores that a term adds, made when first asked for."""

    def __init__(self, row, statistics: Statistics):
        self.doc_ids = np.array([NO_ID if x is None else x for x in row["doc_ids"]], np.int64)
        self.known = np.array([x is not None for x in row["doc_ids"]], bool)
        self.norms = statistics.norms(np.array(row["lengths"], np.int64))
        self.place = {term: k for k, term in enumerate(row["terms"]) if term in statistics.df}
        self.ends = np.array([0, *row["ends"]], np.int64)
        unpress = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(unpress.decompress(row["docs"]), "<u4")
        self.counts = np.frombuffer(unpress.decompress(row["counts"]), "<u4")
        self.statistics = statistics
        self.parts: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, what the term adds to each, the most it adds)."""
        if term not in self.parts:
            k = self.place[term]
            docs = self.docs[self.ends[k] : self.ends[k + 1]]
            tf = self.counts[self.ends[k] : self.ends[k + 1]].astype(np.int64)
            added = self.statistics.weight(term) * (SCALE * tf // (TERM_SCALE * tf + 20 * self.norms[docs]))
            self.parts[term] = docs, added, int(added.max())
        return self.parts[term]

    def best(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` highest scores above 0, ties by document id, best first."""
        listed = [self.postings(t) for t in sorted((t for t in terms if t in self.place), key=lambda t: (self.statistics.df[t], t))]
        remaining = sum(most for _, _, most in listed)
        scores = np.zeros(len(self.doc_ids), np.int64)
        open_, at = True, 0
        while open_ and at < len(listed):
            docs, added, most = listed[at]
            scores[docs] += added
            remaining -= most
            at += 1
            if len(scores) > k and np.count_nonzero(scores) >= k:
                open_ = remaining >= np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores)
        partial = scores[held]
        for docs, added, _ in listed[at:]:
            if not len(held):
                break
            spot = np.searchsorted(docs, held)
            hit = (spot < len(docs)) & (docs[np.minimum(spot, len(docs) - 1)] == held)
            partial[hit] += added[spot[hit]]
        first = np.lexsort((self.doc_ids[held], -partial))[:k]
        return held[first], partial[first]


# --- Search -------------------------------------------------------------------------------------


def item_groups(items: DataFrame, id_col: str, text_col: str, group_terms: int) -> DataFrame:
    """A written table ``part, item_id, text`` of the distinct items, dealt to as many parts as hold ``group_terms`` each."""
    own = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    own = written(own, "items")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + size // (6 * group_terms)
    return own.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the index, one in memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def statistics_of(index: DataFrame, asked: set[str]) -> Statistics:
    """From the whole index; a row per asked term reaches the driver."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            terms, df = [], []
            for term, first, end in zip(row["terms"], [0, *row["ends"]], row["ends"], strict=False):
                if term in sent.value:
                    terms.append(term)
                    df.append(end - first)
            own = [n for n in row["lengths"] if n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *terms], pa.string()), pa.array([len(own), *df], pa.int64()),
                 pa.array([sum(own)] + [0] * len(df), pa.int64())], names=["term", "n", "total"])

    rows = index.select("terms", "ends", "lengths").mapInArrow(run, "term string, n long, total long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    corpus = next((r for r in rows if r["term"] is None), {"n": 0, "total": 0})
    return Statistics(corpus["n"], corpus["total"], {r["term"]: r["n"] for r in rows if r["term"] is not None})


def search(
    index: DataFrame, items: DataFrame, k: int = TOP, item_id_col: str = "item_id", item_text_col: str = "text",
    group_terms: int = GROUP_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    groups = item_groups(items, item_id_col, item_text_col, group_terms)
    kind = groups.schema["item_id"].dataType
    context = index.sparkSession.sparkContext
    found = []
    for part in sorted(r[0] for r in groups.select("part").distinct().collect()):
        rows = groups.filter(F.col("part") == part).orderBy("item_id", "text").collect()  # a group of bounded size
        asked = [sorted({t.decode() for t in terms_of(r["text"])}) for r in rows]
        statistics = statistics_of(index, {t for own in asked for t in own})
        sent = context.broadcast((asked, statistics))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, statistics = sent.value
            for row in rows_of(batches):
                block = Block(row, statistics)
                ranked = [block.best(terms, k) for terms in own]
                docs = np.concatenate([d for d, _ in ranked])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(own), dtype=np.int32), [len(d) for d, _ in ranked])),
                     pa.array(block.doc_ids[docs], pa.int64(), mask=~block.known[docs]),
                     pa.array(np.concatenate([s for _, s in ranked]))], names=["item", "doc_id", "score"])

        names = index.sparkSession.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)],
            "item int, item_id " + kind.simpleString())
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = index.mapInArrow(run, "item int, doc_id long, score long").withColumn("rank", F.row_number().over(order)).filter(
            F.col("rank") <= k)
        found.append(written(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-results"))
    if not found:
        return groups.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
