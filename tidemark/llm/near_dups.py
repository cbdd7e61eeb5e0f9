"""Near-duplicate documents by b-bit MinHash.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets form a class, and
only one member of a class goes on. MinHash minima give band keys, which put candidates into buckets, and the low
bits of the minima, packed, give a signature. Candidates are compared by counting equal signature slots; the
share of equal slots is corrected for chance equality, and pairs far below the threshold are dropped. Everything
that is left is confirmed on the full sets.

No bucket is expanded into its pairs. Its members are tied to its smallest id, and all documents that are tied
together, directly or not, form a cluster; every candidate pair lies inside one cluster. A cluster is cut into
blocks of bounded rows and bytes, and each pair of blocks is compared in one task: signatures choose the documents
that may have partners, and for those the shingles shared with the other block are counted exactly. A task returns a
spanning forest of the links it confirmed, never all of them. So each candidate pair is confirmed or connected
otherwise, whatever the size of its bucket.

Defined results: A-Z are lower-cased, words are runs without white space. A text with fewer words than a shingle
has is one shingle; a null text or one without words has an empty set, is its own component and is kept. Repeated
rows of an id are one node; the result has a row for each of them. A null id sorts below all others and comes back
as null, also as component id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lowered, mixed, whole_text, written

WORDS, PERCENT = 5, 80
#: At a similarity of 0.8 a pair shares no band with a probability of 5e-8, at 0.85 of 6e-11.
BANDS, ROWS, BITS = 32, 4, 4
#: Estimates so far below the threshold are dropped: six standard deviations of the estimate.
DEVIATIONS = 6.0
#: Words a task remembers, shingles hashed at once.
KNOWN_WORDS, CHUNK = 300_000, 512
#: Members of a cluster and bytes of their sets in one block; bits of the table of wanted ids, 8 MB.
BLOCK, BLOCK_BYTES, MAX_BITS = 1_024, 8 << 20, 1 << 26
_NO_ID = -(2**63)
_SIGNED = "id long, n int, fp1 long, fp2 long, sig binary, bands array<long>"


# --- Sets and signatures ------------------------------------------------------------------------


class Shingler:
    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hashes(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes of a text."""
        tokens = lowered(text).split()
        if not tokens:
            return np.empty(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for token in set(tokens).difference(self.known):
            self.known[token] = xxhash.xxh3_64_intdigest(token)
        one = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.words, len(one))
        end = len(one) - n + 1
        out = mixed(one[:end] + np.uint64(n))
        for k in range(1, n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + one[k : end + k])
        return np.unique(out)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:count] | np.uint64(1), numbers[count:]


def minima(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of every permutation, over chunks that stay in the cache."""
    out = np.full(len(factors), 2**64 - 1, np.uint64)
    for first in range(0, len(hashes), CHUNK):
        values = factors[:, None] * hashes[None, first : first + CHUNK]
        values += offsets[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def pack_bits(lows: np.ndarray, bits: int = BITS) -> bytes:
    """The low bits of the minima as bit planes, so that equal slots are found plane by plane."""
    planes = [np.packbits(((lows >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(bits)]
    return b"".join(p.tobytes() for p in planes)


def equal_slots(left: np.ndarray, right: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Matrix of slots whose bits agree, for packed signatures as rows of 64-bit words."""
    width = left.shape[1] // bits
    differ = np.zeros((len(left), len(right), width), np.uint64)
    for b in range(bits):
        differ |= left[:, None, b * width : (b + 1) * width] ^ right[None, :, b * width : (b + 1) * width]
    return 64 * width - np.bitwise_count(differ).sum(axis=2, dtype=np.int32)


def corrected(equal: np.ndarray, slots: int, bits: int = BITS) -> np.ndarray:
    """Similarity from the share of equal slots: unequal minima agree in 2^-bits of all cases."""
    chance = 2.0**-bits
    return (equal / slots - chance) / (1 - chance)


def least_equal(percent: int, slots: int, bits: int = BITS) -> float:
    """Equal slots below which a pair is dropped."""
    share = percent / 100 + (1 - percent / 100) * 2.0**-bits
    return slots * share - DEVIATIONS * (slots * share * (1 - share)) ** 0.5


def _as_words(signatures: Iterable[bytes]) -> np.ndarray:
    rows = list(signatures)
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def signed(rows: DataFrame, words: int, bands: int, rows_per_band: int) -> DataFrame:
    """``id, n, fp1, fp2, sig, bands`` of ``id, text`` rows."""
    slots = bands * rows_per_band
    if slots % 64:
        raise ValueError("bands times rows must be a multiple of 64")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (factors, offsets) = Shingler(words), _permutations(slots)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                hashes = shingler.hashes(text)
                if not len(hashes):
                    out.append((0, 0, 0, b"", None))
                    continue
                lows = minima(hashes, factors, offsets)
                keys = np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows_per_band):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + lows[k::rows_per_band])
                print_ = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
                out.append((len(hashes), int(print_[0]), int(print_[1]), pack_bits(lows), keys.view(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=[c.split()[0] for c in _SIGNED.split(", ")])

    return rows.mapInArrow(run, _SIGNED)


def with_sets(rows: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """``id, hashes`` of the ``id, text`` rows whose id is in ``wanted``; the hashes as bytes.

    The texts stay where they are: a bit table of the wanted ids, of bounded size, lets a task pass over most of the
    others, and the exact join then sees the sets only. A full bit table just passes more.
    """
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    marked = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    size = 1 << 15  # bits of one bitmap
    table = np.zeros((-(-bits // size) + 1, size // 8), np.uint8)
    for r in marked.collect():  # MAX_BITS bits at most
        table[r["bucket"]] = np.frombuffer(r["bitmap"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(words), sent.value
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            found = table[batch.column("bucket").to_numpy(), bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            keep = np.flatnonzero(found)
            texts = batch.column("text").take(pa.array(keep)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep)), pa.array([shingler.hashes(t).tobytes() for t in texts], pa.binary())],
                names=["id", "hashes"])

    placed = rows.withColumn("p", place).select(
        "id", "text", F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("bit"))
    return placed.mapInArrow(run, "id long, hashes binary").join(wanted.select("id"), "id", "left_semi")


# --- Clusters and links -------------------------------------------------------------------------


def block_links(
    ids: np.ndarray, sigs: list[bytes], sets: list[np.ndarray], side: np.ndarray, percent: int, slots: int,
) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (side 0 and 1), or inside one block (side 0 alone)."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inside = not len(right)
    right = left if inside else right
    words = _as_words(sigs)
    near = equal_slots(words[left], words[right]) >= least_equal(percent, slots)
    if inside:
        near = np.triu(near, 1)
    if not near.any():
        return []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    values = np.concatenate([sets[k] for k in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    label, links = np.arange(len(ids)), []
    for x in np.flatnonzero(near.any(axis=1)):
        k = left[x]
        low, high = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
        counts = high - low
        places = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
        both = np.bincount(owner[places], minlength=len(right))
        linked = right[near[x] & (100 * both >= percent * (sizes[k] + sizes[right] - both))]
        parts, first = np.unique(label[linked], return_index=True)
        for part, at in zip(parts, first, strict=True):
            if part != label[k]:
                links.append((int(ids[k]), int(ids[linked[at]])))
                label[label == part] = label[k]
    return links


def cluster_links(members: DataFrame, percent: int, slots: int) -> DataFrame:
    """``a, b`` links that connect all linked members; ``members`` has ``cluster, id, n, sig, hashes``."""
    extent = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a row meets every block of its cluster once: as left side with later blocks, as right side with earlier ones
    spread = members.join(extent, "cluster").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "sig", "hashes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            side, ids = rows.column("side").to_numpy(), rows.column("id").to_numpy()
            sigs, sets, found = rows.column("sig").to_pylist(), rows.column("hashes").to_pylist(), []
            for first, end in zip(ends, ends[1:], strict=False):
                if end - first > 1:
                    own = [np.frombuffer(x, np.uint64) for x in sets[first:end]]
                    found += block_links(ids[first:end], sigs[first:end], own, side[first:end], percent, slots)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            if not len(rows):
                continue
            group = np.stack([rows.column(c).to_numpy() for c in ("cluster", "i", "j")])
            ends = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1])
            rest = rows.slice(int(ends[-1]))
            yield from compared(rows.slice(0, int(ends[-1])), ends)
        if rest is not None:
            yield from compared(rest, np.array([0, len(rest)]))

    return spread.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(
        run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of the ids in ``a, b`` links: alternating large and small stars, a table a step."""
    edges = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct())
        before = state
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low).distinct(), "stars")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    bands: int = BANDS, rows_per_band: int = ROWS,
) -> DataFrame:
    """``<id_col>, n_shingles, component_id, kept``, a row for each row of the documents."""
    slots = bands * rows_per_band
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), whole_text(text_col).alias("text"))
    sigs = written(signed(rows, words, bands, rows_per_band), "near-signatures")
    full = sigs.filter("n > 0")
    # equal sets have equal signatures and bands, so any member's will do
    classes = written(full.groupBy("fp1", "fp2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands")), "near-classes")
    keyed = classes.select("id", F.explode("bands").alias("key"))
    centers = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("center")).filter("n > 1").drop("n")
    ties = keyed.join(centers, "key").filter("center <> id").select(F.col("center").alias("a"), F.col("id").alias("b"))
    clusters = written(components(ties).withColumnRenamed("component", "cluster"), "near-clusters")
    members = clusters.join(classes.select("id", "n", "sig"), "id").join(with_sets(rows, words, clusters), "id")
    links = written(cluster_links(written(members, "near-members"), percent, slots), "near-links")
    of = written(components(links), "near-components")

    low = classes.select("fp1", "fp2", "id").join(of, "id", "left").select(
        "fp1", "fp2", F.coalesce("component", "id").alias("component"))
    # a class may hold a third of all rows; its one row is attached to them by adaptive joins, which split it
    out = full.select("id", "n", "fp1", "fp2").join(low, ["fp1", "fp2"]).select("id", "n", "component").union(
        sigs.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    no_id = F.lit(_NO_ID)
    return out.select(
        F.nullif("id", no_id).alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.nullif("component", no_id).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
