"""Collocations: phrases mined per language by multikey quicksort of suffix pointers.

1. Blocks of texts of one language become numbers: each block has a dictionary of its own words and its text as places
   in it, with a zero at every sentence mark and text end.
2. Words are counted over all blocks, in shards by hash; a block sends each shard its words in one row. The frequent ones
   get numbers, which go back to the blocks that hold them; every other word becomes a zero, as no phrase that holds it
   can be frequent.
3. A suffix is a word with up to ``max_words - 1`` words behind it in its piece. Equal suffixes of a block are merged
   with their count. Suffixes are routed by their leading words: ranges of the sorted suffixes, cut at bounds taken from
   a bounded sample of blocks, which decides only how even the ranges are. A frequent leading word is cut at its second
   word, a frequent pair at its third, and so on.
4. A range is sorted by multikey three-way quicksort to the depth of ``max_words``: the size of each equal part is the
   count of a phrase, and every part below ``min_count`` is abandoned unsorted. Only beginnings of a bound can lie in two
   ranges; they are counted apart and added up.

Defined results: a null text is empty, a null language is ``und``; texts without words, and an empty table, give no
phrase; repeated rows count each. Only the language and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, PACKED, UPPER, small_batches, written
from tidemark.skew import attach_by_group

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Bytes of text in a block; distinct words of blocks in a shard; merged suffixes of a range; suffixes that the bounds are
#: taken from, at most; merged suffixes of a block in a row; phrases that a range sends at once.
BLOCK_BYTES, SHARD_WORDS, RANGE_ROWS, SAMPLE_ROWS, CHUNK_ROWS, SENT_ROWS = 4 << 20, 1 << 18, 1 << 19, 1 << 18, 1 << 16, 1 << 14
#: The characters that end a piece. One of them stands for all.
PIECE_ENDS, END = b".,;:!?\n\x0b\x0c\r", b"."
_TABLE = bytes.maketrans(
    PIECE_ENDS + b"\t" + UPPER.encode(), END * len(PIECE_ENDS) + b" " + LOWER.encode())
BLOCK = "block string, lang string, n_words long, n long, words binary, counts binary, places binary"


def block_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, places): ``places`` holds 1 + the place of each word, and 0 where a piece or text ends."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    joined = pc.binary_join(whole, END.decode())[0].as_buffer().to_pybytes()
    found = joined.translate(_TABLE).replace(END, b" " + END + b" ").split()
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers[END]  # its number is 0
    places = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
    del numbers[END]
    return list(numbers), places


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table with a row per block and language of it."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def block_of(lang: str, texts: list[pa.Array]) -> pa.RecordBatch:
        words, places = block_words(pa.concat_arrays(texts))
        counts = np.bincount(places, minlength=len(words) + 1)[1:].astype("<i8")
        packed = [zstandard.ZstdCompressor(level=1).compress(x) for x in (b" ".join(words), counts.tobytes(), places.tobytes())]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.array([len(words)]), pa.array([int(counts.sum())]),
             *(pa.array([x], pa.binary()) for x in packed)], names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang))
                upto = np.cumsum(pc.binary_length(texts).to_numpy())
                first = 0
                while first < len(texts):
                    # texts up to a full block, one at least
                    space = block_bytes - size.get(lang, 0) + (upto[first - 1] if first else 0)
                    end = max(first + 1, int(np.searchsorted(upto, space)) + 1)
                    waiting.setdefault(lang, []).append(texts[first:end])
                    size[lang] = size.get(lang, 0) + int(upto[min(end, len(upto)) - 1] - (upto[first - 1] if first else 0))
                    if size[lang] >= block_bytes:
                        yield block_of(lang, waiting.pop(lang))
                        size[lang] = 0
                    first = end
        for lang, texts in waiting.items():
            yield block_of(lang, texts)

    return written(rows.mapInArrow(run, BLOCK), "word-blocks", PACKED)


def word_shards(blocks: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, shard, block, words, places, counts``: the blocks' words by hash, a packed row per block and shard."""
    held = blocks.agg(F.sum("n_words")).first()[0] or 0
    n_shards = 1 + held // shard_words

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if not row.n_words:
                    continue
                unpress = zstandard.ZstdDecompressor()
                words = np.array(unpress.decompress(row.words).split(b" "), object)
                shard = pd.util.hash_array(words, categorize=False) % np.uint64(n_shards)
                order = np.argsort(shard, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(shard[order])) + 1, len(order))
                counts = np.frombuffer(unpress.decompress(row.counts), "<i8")
                press = zstandard.ZstdCompressor(level=3)
                parts = [order[a:b] for a, b in zip([0, *ends], ends, strict=False) if a < b]
                yield pd.DataFrame({
                    "lang": row.lang, "shard": [int(shard[p[0]]) for p in parts], "block": row.block,
                    "words": [press.compress(b" ".join(words[p])) for p in parts],
                    "places": [p.astype("<u4").tobytes() for p in parts], "counts": [counts[p].tobytes() for p in parts]})

    return blocks.select("block", "lang", "n_words", "words", "counts").mapInPandas(
        run, "lang string, shard long, block string, words binary, places binary, counts binary")


def frequent_words(blocks: DataFrame, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Written tables of the words that occur often enough: ``lang, word, n, id`` with ids from 1, and ``block, start,
    places, numbers``, a packed row per block and shard with the places of such words in the block's dictionary; the id of
    each is ``start`` and its number.
    """
    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        unpress = zstandard.ZstdDecompressor()
        coded = pa.array(b" ".join(map(unpress.decompress, group["words"])).split(b" "), pa.binary()).dictionary_encode()
        word, n_words = coded.indices.to_numpy(), len(coded.dictionary)
        n = np.zeros(n_words, np.int64)
        np.add.at(n, word, np.frombuffer(b"".join(group["counts"]), "<i8"))
        often = n >= min_count
        number = np.cumsum(often)
        names = coded.dictionary.filter(pa.array(often)).cast(pa.string()).to_pylist()
        out = [pd.DataFrame({"lang": key[0], "shard": key[1], "word": names, "n": n[often], "number": number[often]})]
        first, replies = 0, []
        for block, packed in zip(group["block"], group["places"], strict=True):
            places = np.frombuffer(packed, "<u4")
            own = word[first : first + len(places)]
            first += len(places)
            kept = often[own]
            replies.append((block, places[kept].tobytes(), number[own[kept]].astype("<u4").tobytes()))
        out.append(pd.DataFrame(replies, columns=["block", "places", "numbers"]).assign(lang=key[0], shard=key[1]))
        return pd.concat(out)[["lang", "shard", "word", "n", "number", "block", "places", "numbers"]].astype(
            {"n": "Int64", "number": "Int64"})

    found = written(word_shards(blocks, shard_words).groupBy("lang", "shard").applyInPandas(
        count, "lang string, shard long, word string, n long, number long, block string, places binary, numbers binary"), "word-shards")
    words = found.filter("word IS NOT NULL")
    sizes = words.groupBy("lang", "shard").agg(F.count("*").alias("size"))  # a row per shard
    starts = written(sizes.select("lang", "shard", (F.sum("size").over(Window.orderBy("lang", "shard")) - F.col("size")).alias("start")),
                     "word-starts")
    key = ["lang", "shard"]
    return (attach_by_group(words, starts, key, ["word"]).select("lang", "word", "n", (F.col("start") + F.col("number")).alias("id")),
            attach_by_group(found.filter("block IS NOT NULL"), starts, key, ["block"]).select("block", "start", "places", "numbers"))


def _packed(suffixes: np.ndarray, counts: np.ndarray) -> bytes:
    """Columns one after another; ids have 32 bits where they fit, as the last byte says."""
    width = 4 if not len(suffixes) or suffixes.max() < 1 << 31 else 8
    columns = (suffixes.T.astype(f"<i{width}"), counts.astype("<i8"), np.array([width], np.uint8))
    return zstandard.ZstdCompressor(level=6).compress(b"".join(c.tobytes() for c in columns))


def _unpacked(data: bytes, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = (len(raw) - 1) // (raw[-1] * max_words + 8)
    columns = np.frombuffer(raw, f"<i{raw[-1]}", n * max_words).reshape(max_words, n)
    return columns.T, np.frombuffer(raw, "<i8", n, raw[-1] * n * max_words)


def block_suffixes(places: np.ndarray, ids: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct suffixes in order, a row of ids each with zeros behind its end; how often each occurs)."""
    text = np.concatenate([ids[places], np.zeros(max_words, ids.dtype)])
    n = len(places)
    starts = np.flatnonzero((text[:n] > 0) & (text[1 : n + 1] > 0))
    rows = np.empty((len(starts), max_words), ids.dtype)
    going = np.ones(len(starts), bool)
    for k in range(max_words):
        going &= text[starts + k] > 0
        rows[:, k] = np.where(going, text[starts + k], 0)
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.diff(np.append(first, len(rows)))


def suffix_blocks(
    blocks: DataFrame, numbers: DataFrame, max_words: int = MAX_WORDS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A written table ``block, n, suffixes``: the merged suffixes of frequent words of every block, in ordered chunks."""
    # no more entries than the block has distinct words
    known = numbers.groupBy("block").agg(F.collect_list(F.struct("start", "places", "numbers")).alias("known"))
    rows = blocks.select("block", "places", "n_words").join(known, "block")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.zeros(row.n_words + 1, np.int64)
                for part in row.known:
                    ids[np.frombuffer(part["places"], "<u4") + 1] = part["start"] + np.frombuffer(part["numbers"], "<u4")
                ids = ids.astype(np.int32) if ids.max() < 1 << 31 else ids
                places = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.places), np.uint32)
                suffixes, counts = block_suffixes(places, ids, max_words)
                for a in range(0, len(suffixes), chunk_rows):
                    b = min(a + chunk_rows, len(suffixes))
                    yield pd.DataFrame({"block": [row.block], "n": [b - a], "suffixes": [_packed(suffixes[a:b], counts[a:b])]})

    return written(rows.mapInPandas(run, "block string, n long, suffixes binary"), "suffix-blocks", PACKED)


def sampled_places(n: int, most: int, chance: np.random.Generator) -> np.ndarray:
    """Places below ``n``: one out of each of ``most`` equal parts, or all. Places at the same distances in every chunk
    would meet in few spots of the whole order, as blocks are alike, and leave it uncut between them."""
    ends = np.arange(min(n, most) + 1) * n // min(n, most)
    return ends[:-1] + (chance.random(len(ends) - 1) * np.diff(ends)).astype(int)


def range_bounds(suffixes: DataFrame, max_words: int, range_rows: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Rows that cut all suffixes into ranges of about ``range_rows``; from about ``sample_rows`` suffixes at most."""
    extent = suffixes.agg(F.count("*").alias("chunks"), F.sum("n").alias("rows")).first()
    parts = -(-(extent["rows"] or 0) // range_rows)
    if parts < 2:
        return np.empty((0, max_words), np.int64)
    each = max(1, min(4096, sample_rows // extent["chunks"]))
    share = min(1.0, sample_rows / (each * extent["chunks"]))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance = np.random.default_rng()
        for batch in filter(len, batches):
            taken, weights = [], []
            for data in batch["suffixes"]:
                rows, _ = _unpacked(data, max_words)
                places = sampled_places(len(rows), each, chance)
                taken.append(rows[places].astype(np.int64))
                weights.append(np.full(len(places), len(rows) / len(places)))
            yield pd.DataFrame({"taken": [np.ascontiguousarray(np.concatenate(taken)).tobytes()],
                                "weights": [np.concatenate(weights).tobytes()]})

    chosen = suffixes.filter(F.pmod(F.xxhash64("block"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = chosen.mapInPandas(run, "taken binary, weights binary").collect()  # 48 bytes a suffix
    rows = np.frombuffer(b"".join(r["taken"] for r in sample), np.int64).reshape(-1, max_words)
    weights = np.frombuffer(b"".join(r["weights"] for r in sample), np.float64)
    order = np.lexsort(rows.T[::-1])
    reached = np.cumsum(weights[order])
    cuts = np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts)
    return np.unique(rows[order][cuts], axis=0)


def _below(rows: np.ndarray, bound: np.ndarray) -> int:
    """How many of the ordered rows are smaller than the bound."""
    low, high = 0, len(rows)
    for k, value in enumerate(bound):
        column = rows[low:high, k]
        low, high = low + int(np.searchsorted(column, value)), low + int(np.searchsorted(column, value, "right"))
    return low


def quicksorted_counts(rows: np.ndarray, counts: np.ndarray, min_count: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(phrase, count) of each beginning of two words or more that reaches ``min_count``.

    Multikey three-way quicksort: pointers are parted at one depth by a pivot; a smaller or larger part goes on at this
    depth, the equal one a word deeper. No part below ``min_count`` is looked into.
    """
    depth_limit = rows.shape[1]
    waiting = [(np.arange(len(rows)), 0, ())]
    while waiting:
        pointers, depth, phrase = waiting.pop()
        if counts[pointers].sum() < min_count:
            continue
        column = rows[pointers, depth]
        tried = column[:: 1 + len(column) // 64]
        pivot = np.partition(tried, len(tried) // 2)[len(tried) // 2]
        same = column == pivot
        if not same.all():
            waiting.append((pointers[column < pivot], depth, phrase))
            waiting.append((pointers[column > pivot], depth, phrase))
        total = int(counts[pointers[same]].sum())
        if pivot == 0 or total < min_count:  # the piece ends here, or the part is abandoned
            continue
        longer = (*phrase, int(pivot))
        if len(longer) > 1:
            yield longer, total
        if depth + 1 < depth_limit:
            waiting.append((pointers[same], depth + 1, longer))


def _counts_of(phrases: Iterable[tuple[int, ...]], rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
    for phrase in phrases:
        total = int(counts[(rows[:, : len(phrase)] == np.array(phrase)).all(axis=1)].sum())
        if total:
            yield phrase, total


def phrase_counts(
    suffixes: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """A written table ``key array<long>, n``: all phrases of two words or more that occur ``min_count`` times."""
    bounds = range_bounds(suffixes, max_words, range_rows)
    sent = suffixes.sparkSession.sparkContext.broadcast(bounds)  # a row per range of the shuffle

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["suffixes"]:
                rows, counts = _unpacked(data, max_words)
                # only these bounds can cut the chunk
                first, last = _below(sent.value, rows[0]), _below(sent.value, rows[-1])
                ends = [0, *(_below(rows, bound) for bound in sent.value[first : last + 1]), len(rows)]
                parts = [k for k in range(len(ends) - 1) if ends[k] < ends[k + 1]]
                yield pd.DataFrame({
                    "part": [first + k for k in parts],
                    "suffixes": [_packed(rows[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]) for k in parts]})

    def sort_range(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = int(key[0])
        unpacked = [_unpacked(data, max_words) for batch in batches for data in batch["suffixes"]]
        rows, counts = np.concatenate([r for r, _ in unpacked]), np.concatenate([c for _, c in unpacked])
        del unpacked
        cut = set()
        for bound in sent.value[max(0, part - 1) : part + 1].tolist():  # where this range begins and ends
            filled = bound[: bound.index(0)] if 0 in bound else bound
            cut |= {tuple(filled[:k]) for k in range(2, len(filled) + 1)}
        found = chain(((p, n, False) for p, n in quicksorted_counts(rows, counts, min_count) if p not in cut),
                      ((p, n, True) for p, n in _counts_of(sorted(cut), rows, counts)))
        while some := list(islice(found, SENT_ROWS)):
            yield pd.DataFrame({"key": [list(p) for p, _, _ in some], "n": [n for _, n, _ in some], "cut": [c for _, _, c in some]})

    ranges = suffixes.mapInPandas(route, "part long, suffixes binary").groupBy("part").applyInPandas(
        sort_range, "key array<long>, n long, cut boolean")
    ranges = written(ranges, "range-phrases")
    # beginnings of bounds, four a range at most, lie in several ranges
    joined = ranges.filter("cut").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return written(ranges.filter("NOT cut").select("key", "n").unionByName(joined), "phrase-counts")


def _scores(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of up to 38 digits."""
    a, n, left, right = (c.cast("decimal(16,0)") for c in (a, n, left, right))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (a * n), left * right)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    top: int = TOP, block_bytes: int = BLOCK_BYTES, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by their weakest cut."""
    with small_batches(docs.sparkSession):
        blocks = word_blocks(docs, text_col, lang_col, block_bytes)
        words, numbers = frequent_words(blocks, min_count)
        phrases = phrase_counts(suffix_blocks(blocks, numbers, max_words), min_count, max_words, range_rows)
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = phrases.select("key", "n").unionByName(words.select(F.array("id").alias("key"), "n"))

    # a phrase inside a longer one of the same count is inside one that is a word longer, too
    inside = phrases.filter(F.size("key") > 2).select(
        F.explode(F.array(F.slice("key", 1, F.size("key") - 1), F.expr("slice(key, 2, size(key) - 1)"))).alias("key"), "n").distinct()
    own = phrases.join(inside, ["key", "n"], "left_anti").withColumnRenamed("n", "a")
    cuts = own.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k")).select(
        "key", "a", "k", F.expr("slice(key, 1, k)").alias("left"), F.expr("slice(key, k + 1, size(key) - k)").alias("right"))
    cuts = attach_by_group(cuts, parts.select(F.col("key").alias("left"), F.col("n").alias("l")), ["left"], ["key"])
    cuts = attach_by_group(cuts, parts.select(F.col("key").alias("right"), F.col("n").alias("r")), ["right"], ["key"])
    # the words of a phrase, and with its first one the language
    spelt = attach_by_group(
        own.select("key", F.posexplode("key").alias("place", "id")), words.select("id", "word", "lang"), ["id"], ["key"]
    ).groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.any_value("lang").alias("lang"))
    weighed = cuts.join(spelt, "key")
    weighed = attach_by_group(weighed, sizes, ["lang"], ["key"]).withColumn(
        "score", _scores(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = weighed.groupBy("lang", "key", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return weakest.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score").withColumn(
        "rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
