"""Line deduplication through a sharded minimal perfect hash.

Every distinct line key of the corpus is a 128-bit hash. The distinct hashes are cut into shards of bounded
size; a shard holds a minimal perfect hash and, in its slot order, compact arrays of fingerprints, document
counts and largest document ids. Documents send the hashes of their own keys to the shards, look their counts
up in the arrays, and get back the hashes they must drop. Lines themselves are never shuffled or joined.

Defined results: a null or empty text is one empty line. Documents are told apart by their id, so repeated rows
of an id count once and lose the same lines; a null id is a document below all others. A key of
``min_chars`` code points or more in ``min_docs`` documents or more stays only in the largest id, in every line
of it that has the key. Other columns of the input are returned untouched, except that the columns
``n_lines, n_dropped, kept_text`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, WHITE, lowered, mixed, whole_text, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Distinct hashes in a shard, and look-ups that one task answers for it.
SHARD_KEYS, GROUP_PROBES = 250_000, 250_000
#: Shards at most, so that the broadcast table of shard widths is under a megabyte; shards grow beyond it.
MAX_SHARDS = 65_536
_SECOND = 7
_SEED = 42
_SECOND_SEED = xxhash.xxh64_intdigest(_SECOND.to_bytes(4, "little"), _SEED)
_NO_ID = -(2**63)
RESULT = ["n_lines", "n_dropped", "kept_text"]


# --- Minimal perfect hash -----------------------------------------------------------------------


def _slots(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return mixed(first ^ mixed(second + salt)) % np.uint64(size)


def build_hash(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Bit arrays by level: a key's bit is set on the first level where no other key shares its place."""
    levels = []
    while len(first):
        size = max(64, (2 * len(first) + 7) // 8 * 8)
        place = _slots(first, second, len(levels), size)
        shared = np.bincount(place.astype(np.int64), minlength=size)
        levels.append(np.packbits(shared == 1))
        left = shared[place.astype(np.int64)] > 1
        first, second = first[left], second[left]
        if len(levels) > 200:
            raise ValueError("equal hashes in one shard; keys must be distinct")
    return levels


def look_up(levels: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The slot 0..n-1 of every key; -1 for keys that no level holds."""
    found = np.full(len(first), -1, np.int64)
    todo, before = np.arange(len(first)), 0
    for level, packed in enumerate(levels):
        bits = np.unpackbits(packed)
        ranks = np.cumsum(bits, dtype=np.int64)
        place = _slots(first[todo], second[todo], level, len(bits)).astype(np.int64)
        hit = bits[place] == 1
        found[todo[hit]] = before + ranks[place[hit]] - 1
        todo, before = todo[~hit], before + int(ranks[-1])
        if not len(todo):
            break
    return found


_INDEX = "shard int, sizes array<int>, bits binary, prints binary, counts binary, lasts binary"


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows["h1"].to_numpy(np.int64).view(np.uint64)
    second = rows["h2"].to_numpy(np.int64).view(np.uint64)
    levels = build_hash(first, second)
    slot = look_up(levels, first, second)
    prints, counts, lasts = (np.zeros(len(rows), kind) for kind in (np.uint32, np.int64, np.int64))
    prints[slot] = second.astype(np.uint32)
    counts[slot], lasts[slot] = rows["n_docs"], rows["last_doc"]
    # a count needs only as many bytes as the shard's largest
    counts = counts.astype(np.min_scalar_type(int(counts.max())))
    return pd.DataFrame({
        "shard": [np.int32(rows["shard"].iloc[0])], "sizes": [[len(x) for x in levels] + [counts.dtype.itemsize]],
        "bits": [b"".join(x.tobytes() for x in levels)], "prints": [prints.tobytes()],
        "counts": [counts.tobytes()], "lasts": [lasts.tobytes()],
    })


def _probe_shard(probes: pd.DataFrame, index: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    if not len(probes):
        return probes[["id", "h1", "h2"]]
    shard = index.iloc[0]
    *sizes, width = (int(x) for x in shard["sizes"])
    bits = np.frombuffer(shard["bits"], np.uint8)
    levels = np.split(bits, np.cumsum(sizes)[:-1])
    first = probes["h1"].to_numpy(np.int64).view(np.uint64)
    second = probes["h2"].to_numpy(np.int64).view(np.uint64)
    slot = look_up(levels, first, second)
    prints = np.frombuffer(shard["prints"], np.uint32)
    if (slot < 0).any() or (prints[slot] != second.astype(np.uint32)).any():
        raise ValueError("a line hash is missing from its shard")
    counts = np.frombuffer(shard["counts"], np.dtype(f"u{width}"))[slot]
    lasts = np.frombuffer(shard["lasts"], np.int64)[slot]
    return probes.loc[(counts >= min_docs) & (probes["id"].to_numpy(np.int64) != lasts), ["id", "h1", "h2"]]


# --- Keys of a document -------------------------------------------------------------------------


def _key_hashes(text: Column, min_chars: int) -> Column:
    """array<struct<h1, h2>> of a text's distinct long keys."""
    keys = F.transform(F.split(text, "\n"), lambda x: F.translate(F.btrim(x, F.lit(WHITE)), UPPER, LOWER))
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    return F.transform(long, lambda k: F.struct(
        F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(_SECOND), k).alias("h2")))


def _without(text: str, drops, min_chars: int) -> tuple[int, int, str]:
    if drops is None or not len(drops):
        return text.count("\n") + 1, 0, text
    numbers = np.asarray(drops, np.int64).view(np.uint64).tolist()
    gone = set(zip(numbers[0::2], numbers[1::2], strict=True))
    lines, kept = text.split("\n"), []
    for line in lines:
        stripped = line.strip(WHITE)
        if len(stripped) >= min_chars:
            key = lowered(stripped)
            if (xxhash.xxh64_intdigest(key, _SEED), xxhash.xxh64_intdigest(key, _SECOND_SEED)) in gone:
                continue
        kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def line_index(probes: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, DataFrame, int]:
    """(index rows, look-ups per shard, number of shards) over distinct ``id, h1, h2`` rows."""
    counts = written(
        probes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_doc")), "line-counts")
    n_shards = min(MAX_SHARDS, max(1, -(-counts.count() // shard_keys)))
    placed = counts.withColumn("shard", _shard(n_shards))
    index = written(placed.groupBy("shard").applyInPandas(_pack_shard, _INDEX), "line-index")
    return index, placed.groupBy("shard").agg(F.sum("n_docs").alias("n_probes")), n_shards


def _shard(n_shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 7), F.lit(n_shards)).cast("int")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    id_value = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    keyed = docs.select(id_value.alias("id"), F.explode(_key_hashes(whole_text(text_col), min_chars)).alias("k"))
    probes = written(keyed.select("id", "k.h1", "k.h2").distinct(), "line-probes")
    index, loads, n_shards = line_index(probes)

    # a shard with many look-ups is read by several tasks; the table has MAX_SHARDS short rows at most
    widths = loads.select("shard", F.ceil(F.col("n_probes") / GROUP_PROBES).cast("int").alias("width"))
    spread = probes.withColumn("shard", _shard(n_shards)).join(F.broadcast(widths), "shard").select(
        "shard", F.pmod(F.xxhash64("id"), F.col("width")).cast("int").alias("salt"), "id", "h1", "h2")
    copies = index.join(F.broadcast(widths), "shard").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).drop("width")
    hits = spread.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(
        lambda left, right: _probe_shard(left, right, min_docs), "id long, h1 long, h2 long")
    drops = hits.groupBy("id").agg(F.flatten(F.collect_list(F.array("h1", "h2"))).alias("__drops"))

    @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            rows = [_without(t, g, min_chars) for t, g in zip(texts, gone, strict=True)]
            yield pd.DataFrame(rows, columns=RESULT)

    carried = [c for c in docs.columns if c not in RESULT]
    joined = docs.select(*carried, id_value.alias("__id")).join(
        drops.withColumnRenamed("id", "__id"), "__id", "left")
    return joined.withColumn("__c", cleaned(whole_text(text_col), F.col("__drops"))).select(
        *carried, *[F.col(f"__c.{c}").alias(c) for c in RESULT])
