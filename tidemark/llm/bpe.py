"""Byte-level BPE by merge replay over blocks of the corpus.

The texts of a block are cut into pieces by the vocabulary's pattern, and the block's distinct pieces that are no
token by themselves are laid side by side, some thousands at a time. An inverted index from the rank of a pair to its positions then replays
the merges in rank order: every merge visits just the positions listed for it and looks up only the pairs that its
two neighbours form. Where a merge makes a pair of lower rank, the rest of that piece waits for it, so every piece
ends as if it had been encoded alone. Pieces seen before are taken from bounded tables. Blocks are bounded by
their text, not by the partition, and nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; special
tokens are ordinary text. Columns named ``ids`` (encode) and ``decoded`` (decode) are replaced, all others kept. A
null array of ids decodes to no bytes; an id outside the vocabulary, or null, is an error.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import with_fields

#: Code points of text in a block; bytes of the parts and of the pieces that a task remembers between blocks, in two
#: generations each; pairs that it remembers.
BLOCK_CHARS, KNOWN_BYTES, KNOWN_PAIRS = 1_000_000, 160_000_000, 200_000
#: What an entry takes besides its text and ids: two objects and its place in the table.
ENTRY_BYTES = 160
#: Distinct pieces whose merges are replayed together: their positions stay in the cache.
REPLAY_WORDS = 8_000
#: Bytes of texts decoded at once.
DECODE_BYTES = 8 << 20


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


class PairRanks(dict):
    """Ranks of pairs of tokens, ``left << 32 | right``, looked up in the vocabulary once; -1 if they do not merge."""

    def __init__(self, ranks: dict[bytes, int], table: list[bytes]):
        super().__init__()
        self.ranks, self.table = ranks, table
        self.single = np.array([ranks[bytes((x,))] for x in range(256)], np.int64)
        self.of_bytes = np.array([[ranks.get(bytes((x, y)), -1) for y in range(256)] for x in range(256)], np.int64)

    def __missing__(self, pair: int) -> int:
        found = self[pair] = self.ranks.get(self.table[pair >> 32] + self.table[pair & 0xFFFFFFFF], -1)
        return found


def replay_merges(words: list[bytes], pairs: PairRanks) -> list[bytes]:
    """Ids of each word, as 32-bit numbers, all words merged together in rank order."""
    if not words:
        return []
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    ends, n = np.cumsum(lengths), len(data)
    after_all, before_all = np.arange(1, n + 1), np.arange(-1, n - 1)
    after_all[ends - 1] = -1
    before_all[ends - lengths] = -1
    tokens: list[int] = pairs.single[data].tolist()
    owner: list[int] = np.repeat(np.arange(len(words)), lengths).tolist()
    after: list[int] = after_all.tolist()
    before: list[int] = before_all.tolist()
    # the index: the first pairs of all words, sorted by rank and, within a rank, by position
    first_ranks = np.full(n, -1, np.int64)
    first_ranks[:-1] = pairs.of_bytes[data[:-1], data[1:]]
    first_ranks[ends - 1] = -1
    order = np.argsort(first_ranks, kind="stable")
    order = order[np.searchsorted(first_ranks[order], 0) :]
    ranks, starts = np.unique(first_ranks[order], return_index=True)
    listed_all = order.tolist()
    stops = [*starts[1:].tolist(), len(listed_all)][: len(starts)]
    places: dict[int, list[int]] = {
        rank: listed_all[x:y] for rank, x, y in zip(ranks.tolist(), starts.tolist(), stops, strict=True)}
    queue = list(places)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        if rank not in places:
            continue
        waiting, paused = [], -1
        listed = places.pop(rank)
        if len(listed) > 1:
            listed.sort()
        for i in listed:
            if owner[i] == paused:
                waiting.append(i)
                continue
            j = after[i]
            if j < 0 or tokens[i] < 0 or pairs[tokens[i] << 32 | tokens[j]] != rank:
                continue
            tokens[i], tokens[j] = rank, -1
            right = after[i] = after[j]
            left = before[i]
            if right >= 0:
                before[right] = i
                made = pairs[rank << 32 | tokens[right]]
                if made >= 0:
                    if made in places:
                        places[made].append(i)
                    else:
                        places[made] = [i]
                        heapq.heappush(queue, made)
                    if made < rank:
                        paused = owner[i]
            if left >= 0:
                made = pairs[tokens[left] << 32 | rank]
                if made >= 0:
                    if made in places:
                        places[made].append(left)
                    else:
                        places[made] = [left]
                        heapq.heappush(queue, made)
                    if made < rank:
                        paused = owner[i]
        if waiting:
            places.setdefault(rank, []).extend(waiting)
            heapq.heappush(queue, rank)
    left_over = np.array(tokens, "<i4")
    alive = left_over >= 0
    packed = left_over[alive].tobytes()
    cuts = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
    return [packed[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


# White space beside a space: only there does a piece reach over a space, or end before one.
_RUN = re.compile(r" \s|\s ")


class Known:
    """Ids by text in two generations, bounded by bytes: what is not asked for while the newer one fills is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.size = limit // 2, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, texts: set[str]) -> list[str]:
        """Those of the texts that are in no generation; the others are in the newer one afterwards."""
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        unknown = texts.difference(self.new)
        again = unknown.intersection(self.old)
        self.update(again, list(map(self.old.__getitem__, again)))
        return list(unknown.difference(again))

    def update(self, texts: Iterable[str], ids: list[bytes]) -> None:
        """The ids of texts that the newer generation does not hold."""
        self.new.update(zip(texts, ids, strict=True))
        self.size += ENTRY_BYTES * len(ids) + sum(map(len, texts)) + sum(map(len, ids))


class BlockEncoder:
    """Encodes blocks of texts; a task has one of its own, so workers that wait for other work hold no pieces.

    A single space between other characters always begins a piece and nothing looks back over it, so a text
    is taken as its parts between spaces, each with the space before it. The pattern cuts every distinct part
    once; texts with runs of white space around a space are one part.
    """

    def __init__(self, path: str, pattern: str, known_bytes: int = KNOWN_BYTES):
        self.ranks = read_ranks(path)
        self.pairs = PairRanks(self.ranks, token_bytes(path))
        self.cut = regex.compile(pattern)
        self.spaced = Known(known_bytes)  # parts without their leading space
        self.pieces = Known(known_bytes)

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts, as 32-bit numbers: their pieces that are new are merged together."""
        cuts = [self.cut.findall(part) for part in parts]
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        collecting = gc.isenabled()
        gc.disable()  # millions of small lists, and no cycles among them
        wanted = self.pieces.missing(set(chain.from_iterable(cuts)))
        coded = [piece.encode("utf-8") for piece in wanted]
        ranks = list(map(self.ranks.get, coded))
        whole = [k for k, rank in enumerate(ranks) if rank is not None]
        single = np.array([ranks[k] for k in whole], "<i4").tobytes()
        self.pieces.update([wanted[k] for k in whole], [single[x : x + 4] for x in range(0, len(single), 4)])
        fresh = [k for k, rank in enumerate(ranks) if rank is None]
        for first in range(0, len(fresh), REPLAY_WORDS):
            own = fresh[first : first + REPLAY_WORDS]
            self.pieces.update([wanted[k] for k in own], replay_merges([coded[k] for k in own], self.pairs))
        if collecting:
            gc.enable()
        get = self.pieces.new.__getitem__
        return [get(cut[0]) if len(cut) == 1 else b"".join(map(get, cut)) for cut in cuts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends of the texts, ids of all of them)."""
        split = [[text] if _RUN.search(text) else text.split(" ") for text in texts]
        heads = [parts[0] for parts in split]
        fresh = self.spaced.missing(set(chain.from_iterable(parts[1:] for parts in split)))
        found = self._learn([*heads, *(" " + part for part in fresh)])
        self.spaced.update(fresh, found[len(heads):])
        get = self.spaced.new.__getitem__
        rows = [head + b"".join(map(get, parts[1:])) for head, parts in zip(found, split, strict=False)]
        ends = np.cumsum([0, *(len(row) // 4 for row in rows)], dtype=np.int64)
        return ends, np.frombuffer(b"".join(rows), "<i4")


def runs_of(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of about ``most`` in size together; a larger row is a run of its own."""
    first = total = end = 0
    for end, size in enumerate(sizes, 1):
        if end - 1 > first and total + size > most:
            yield first, end - 1
            first, total = end - 1, 0
        total += size
    if end:
        yield first, end


def blocks_of(texts: list[str], block_chars: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``block_chars``; a longer text is a block of its own."""
    return runs_of(map(len, texts), block_chars)


def _encoded(
    batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str, text_col: str, block_chars: int,
) -> Iterator[pa.RecordBatch]:
    encoder = BlockEncoder(ranks_path, pattern)
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist()
        for first, end in runs_of(sizes, block_chars):
            own = batch.slice(first, end - first)
            ends, ids = encoder.encode([x or "" for x in own.column(text_col).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*own.schema.names, "ids"])


def _decoded(batches: Iterable[pa.RecordBatch], ranks_path: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    table = pa.array(token_bytes(ranks_path), pa.large_binary())
    sizes = np.diff(np.frombuffer(table.buffers()[1], np.int64, len(table) + 1))
    for batch in batches:
        column = batch.column(ids_col)
        ids = column.flatten()  # without what null rows hold
        if ids.null_count or (len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(table)):
            raise ValueError("an id outside the vocabulary")
        # tokens laid end to end are the texts laid end to end
        lengths = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], np.cumsum(sizes[ids.to_numpy(zero_copy_only=False)])])[lengths]
        for first, end in runs_of(np.diff(ends).tolist(), DECODE_BYTES):
            some = table.take(ids.slice(lengths[first], lengths[end] - lengths[first]))
            offsets = pa.py_buffer((ends[first : end + 1] - ends[first]).astype(np.int32))
            texts = pa.BinaryArray.from_buffers(pa.binary(), end - first, [None, offsets, some.buffers()[2]])
            own = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([*own.columns, texts], names=[*own.schema.names, "decoded"])


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents with ``ids array<int>``."""
    docs = docs.select(*[c for c in docs.columns if c != "ids"])
    return docs.mapInArrow(
        lambda batches: _encoded(batches, ranks_path, pattern, text_col, block_chars), with_fields(docs.schema, "ids array<int>"))


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded binary``, the bytes that the ids stand for."""
    rows = rows.select(*[c for c in rows.columns if c != "decoded"])
    return rows.mapInArrow(lambda batches: _decoded(batches, ranks_path, ids_col), with_fields(rows.schema, "decoded binary"))


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``decode`` of ``encode`` in one pass: a task has one Python worker, and ids cross to the next step once."""
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")])
    return docs.mapInArrow(
        lambda batches: _decoded(_encoded(batches, ranks_path, pattern, text_col, block_chars), ranks_path, "ids"),
        with_fields(docs.schema, "ids array<int>, decoded binary"))
