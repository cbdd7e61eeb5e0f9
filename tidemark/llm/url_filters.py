"""URL filters: host and path rules, and a Bloom filter cascade for long lists.

The cascade answers exactly for every key of a complete universe. Level 0 is a Bloom filter of the listed keys;
level 1 holds the unlisted keys of the universe that pass level 0 by chance; level 2 the listed ones that pass level
1; and so on until a level lets nothing through by chance. A key is listed if the first level that does not hold it
is an odd one. The keys are cut into shards by hash, each with a cascade of its own, built in parallel.

A cascade is a few bits per listed key. Up to ``max_broadcast_bytes``, measured, it goes to every task; a larger
one stays in its shards, and the rows pass by them, salted, instead.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is looked up under
the empty key. Listed keys outside the universe are ignored, null and repeated ones too. An empty list lets all
pass. Repeated rows are judged each. Columns named like a result are replaced, all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, mixed, with_fields, written

SHARD_KEYS, MAX_SHARDS = 500_000, 65_536
MAX_BROADCAST_BYTES, GROUP_ROWS = 32 << 20, 250_000
_LEVELS = "shard int, sizes array<int>, hashes array<int>, bits binary"
RESULT = ["host", "path", "rule", "verdict"]


# --- Urls and rules -----------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def url_key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule ``(action, host, path)`` that fits; null if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return text, action


# --- The cascade --------------------------------------------------------------------------------


def _places(first: np.ndarray, second: np.ndarray, level: int, k: int, size: int) -> Iterator[np.ndarray]:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    start, step = mixed(first ^ salt), mixed(second + salt) | np.uint64(1)
    for i in range(k):
        yield ((start + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)


def _holds(bits: np.ndarray, first: np.ndarray, second: np.ndarray, level: int, k: int, size: int) -> np.ndarray:
    out = np.ones(len(first), bool)
    for place in _places(first, second, level, k, size):
        out &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def build_cascade(first: np.ndarray, second: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(bits, hash functions, packed bits) of each level."""
    inside, outside = (first[listed], second[listed]), (first[~listed], second[~listed])
    levels: list[tuple[int, int, np.ndarray]] = []
    while len(inside[0]):
        if len(levels) > 100:
            raise ValueError("a listed and an unlisted key share their hashes")
        n, others = len(inside[0]), max(1, len(outside[0]))
        rate = min(0.5, n / others / math.sqrt(2)) if not levels else 0.5
        k = max(1, round(-math.log2(rate)))
        size = max(64, math.ceil(n * k / math.log(2)))
        flags = np.zeros(size, np.uint8)
        for place in _places(*inside, len(levels), k, size):
            flags[place] = 1
        bits = np.packbits(flags, bitorder="little")
        passing = _holds(bits, *outside, len(levels), k, size)
        levels.append((size, k, bits))
        inside, outside = (outside[0][passing], outside[1][passing]), inside
    return levels


def in_cascade(levels: list[tuple[int, int, np.ndarray]], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    found = np.zeros(len(first), bool)
    rest = np.arange(len(first))
    for level, (size, k, bits) in enumerate(levels):
        rest = rest[_holds(bits, first[rest], second[rest], level, k, size)]
        found[rest] = level % 2 == 0
    return found


def _unpack(sizes, hashes, bits: bytes) -> list[tuple[int, int, np.ndarray]]:
    sizes = [int(x) for x in sizes]
    ends = np.cumsum([0, *(-(-x // 8) for x in sizes)]).tolist()
    data = np.frombuffer(bits, np.uint8)
    return [(s, int(k), data[a:b]) for s, k, a, b in zip(sizes, hashes, ends, ends[1:], strict=False)]


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    levels = build_cascade(rows["h1"].to_numpy(np.int64).view(np.uint64), rows["h2"].to_numpy(np.int64).view(np.uint64),
                           rows["listed"].to_numpy(bool))
    return pd.DataFrame({
        "shard": [np.int32(rows["shard"].iloc[0])], "sizes": [[x[0] for x in levels]],
        "hashes": [[x[1] for x in levels]], "bits": [b"".join(x[2].tobytes() for x in levels)],
    })


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def _shard(n_shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 7), F.lit(n_shards)).cast("int")


def cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(written shard rows, number of shards) for one-column frames of keys."""
    def side(frame: DataFrame, flag: int) -> DataFrame:
        key = F.col(frame.columns[0])
        return frame.filter(key.isNotNull()).select(*_hashed(key), F.lit(flag).alias("flag"))

    # flag 1 marks the universe, 2 the list; a key counts if the universe has it
    keys = written(side(universe, 1).union(side(listed, 2)).groupBy("h1", "h2").agg(
        F.min("flag").alias("low"), F.max("flag").alias("high")).filter("low = 1").select(
        "h1", "h2", (F.col("high") == 2).alias("listed")), "cascade-keys")
    n_shards = min(MAX_SHARDS, max(1, -(-keys.count() // shard_keys)))
    shards = keys.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(_build_shard, _LEVELS)
    return written(shards, "cascade"), n_shards


def with_membership(
    rows: DataFrame, key: Column, shards: DataFrame, n_shards: int, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The rows with ``listed boolean``."""
    rows = rows.select(*[c for c in rows.columns if c != "listed"])
    size = shards.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    placed = rows.select("*", *[h.alias(n) for h, n in zip(_hashed(key), ("__h1", "__h2"), strict=True)])
    shard = F.pmod(F.shiftright("__h1", 7), F.lit(n_shards)).cast("int")
    names, schema = list(rows.columns), with_fields(rows.schema, "listed boolean")
    if size <= max_broadcast_bytes:
        sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in shards.collect()])
        placed = placed.withColumn("__shard", shard)

        def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {r[0]: _unpack(*r[1:]) for r in sent.value}
            for batch in batches:
                first, second = (batch.column(c).to_numpy().view(np.uint64) for c in ("__h1", "__h2"))
                own, listed = batch.column("__shard").to_numpy(), np.zeros(batch.num_rows, bool)
                for k in np.unique(own):
                    at = np.flatnonzero(own == k)
                    listed[at] = in_cascade(known.get(int(k), []), first[at], second[at])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(listed)], names=[*names, "listed"])

        return placed.mapInArrow(look_up, schema)

    loads = placed.withColumn("__shard", shard).groupBy("__shard").count().select(
        "__shard", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("__width"))
    # MAX_SHARDS short rows at most
    salted = placed.withColumn("__shard", shard).join(F.broadcast(loads), "__shard").withColumn(
        "__salt", F.pmod(F.xxhash64(*names), F.col("__width")).cast("int")).drop("__width")
    copies = shards.withColumnRenamed("shard", "__shard").join(F.broadcast(loads), "__shard").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.col("__width") - 1))).drop("__width")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = _unpack(*(right.column(c)[0].as_py() for c in ("sizes", "hashes", "bits"))) if len(right) else []
        first, second = (left.column(c).to_numpy().view(np.uint64) for c in ("__h1", "__h2"))
        return left.select(names).append_column("listed", pa.array(in_cascade(levels, first, second)))

    return salted.groupBy("__shard", "__salt").cogroup(copies.groupBy("__shard", "__salt")).applyInArrow(probe, schema)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url_col: str = "url",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The rows with ``host, path, rule, verdict``: the longest rule's action, else block for listed keys.

    ``listed`` holds keys, host and path joined; the universe is every key of ``pages``.
    """
    rows = pages.select(*[c for c in pages.columns if c not in (*RESULT, "listed")])
    rows = rows.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    key = url_key(F.col("host"), F.col("path"))
    shards, n_shards = cascade(rows.select(key.alias("key")), listed)
    rows = with_membership(rows, key, shards, n_shards, max_broadcast_bytes)
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(action, method)})
