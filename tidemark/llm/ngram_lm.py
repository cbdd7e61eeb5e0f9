"""A two-level n-gram model in an Elias-Fano trie.

Level 1 is the vocabulary: the sorted 64-bit hashes of all training tokens as Elias-Fano sequences, with their exact
counts; a word's place is its id. Level 2 holds the followers of every word. Its child ids are made monotone by
their context's place, coded by Elias-Fano and searched for the successor of a context-relative value; monotone
pointers give the number of followers of a context; every child has a 16-bit code of its discounted probability.
A pair's probability is the discounted one plus the context's left-over mass times the unigram probability, which
sums to one over the vocabulary and the unseen word.

Both levels are cut into files in the shared folder, by ranges of about equal token mass; a context with more
mass than a file is cut by its children. Tasks map the files they need into memory. Counting sends every block's
distinct pairs, packed and compressed, to the file's range; no count is dropped.

Defined results: a null or empty text has one token, the end. A document learns or is held out by its id; a null id
is the text ``null``'s, as is an id of repeated rows: each row counts. Without training tokens every token has
the probability 1: it is the unseen word. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import blocks_of
from tidemark.llm.common import lowered, mapped, new_folder, whole_text, with_fields, write_file, written

DISCOUNT = 0.75
#: Values that the code book of a file has; codes take 16 bits.
CODES = 1 << 16
#: Words in a vocabulary file and token mass of a pair file.
FILE_WORDS, FILE_TOKENS = 1 << 20, 1 << 21
#: Code points of text in a block, words a task remembers, files a task keeps open.
BLOCK_CHARS, KNOWN_WORDS, OPEN_FILES = 12_000_000, 400_000, 4096
#: No word has white space, so no word has the end's hash by its text.
END = xxhash.xxh3_64_intdigest(b" end ")


# --- Elias-Fano ---------------------------------------------------------------------------------


def elias_fano(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Sections of a non-decreasing sequence below ``universe``."""
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    low_bits = min(low_bits, 57)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    n_bits = n + (int(universe) >> low_bits) + 2
    upper = np.zeros(-(-n_bits // 64) * 64, np.uint8)
    upper[high + np.arange(n)] = 1
    words = np.packbits(upper, bitorder="little").view(np.uint64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
    low = np.zeros(-(-n * low_bits // 64) + 2, np.uint64)
    if low_bits:
        at = np.arange(n, dtype=np.int64) * low_bits
        part = values & np.uint64((1 << low_bits) - 1)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, part << shift)
        over = np.where(shift == 0, np.uint64(0), part >> (np.uint64(64) - np.maximum(shift, np.uint64(1))))
        np.bitwise_or.at(low, word + 1, over)
    return {"upper": words, "zeros": zeros.astype(np.uint32), "low": low, "meta": np.array([n, low_bits], np.int64)}


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th set bit of each word."""
    place = np.zeros(len(words), np.uint64)
    rank = rank.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count((words >> place) & np.uint64((1 << step) - 1)).astype(np.int64)
        beyond = rank >= below
        rank = rank - np.where(beyond, below, 0)
        place += np.where(beyond, np.uint64(step), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    def __init__(self, sections: dict[str, np.ndarray], name: str = ""):
        self.upper, self.zeros, self.low = (sections[name + x] for x in ("upper", "zeros", "low"))
        self.n, self.low_bits = (int(x) for x in sections[name + "meta"])
        self._ones: np.ndarray | None = None

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank, "right") - 1
        return word * 64 + _select(~self.upper[word], rank - self.zeros[word].astype(np.int64))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= np.where(shift == 0, np.uint64(0), self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))))
        return value & np.uint64((1 << self.low_bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(self._ones, at, "right") - 1
        place = word * 64 + _select(self.upper[word], at - self._ones[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 if the sequence lacks it: the successor within the values' high part."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        want = values & np.uint64((1 << self.low_bits) - 1)
        end = self._zero(high) - high
        start = np.where(high == 0, 0, self._zero(np.maximum(high, 1) - 1) + 1 - high)
        first, last = start, end
        while (open_ := first < last).any():  # halving all ranges at once
            middle = (first + last) >> 1
            less = open_ & (self._lows(np.where(open_, middle, 0)) < want)
            first = np.where(less, middle + 1, first)
            last = np.where(open_ & ~less, middle, last)
        there = first < end
        there &= self._lows(np.where(there, first, 0)) == want
        return np.where(there, first, -1)


# --- Level files --------------------------------------------------------------------------------


def save(folder: str, stem: str, sections: dict[str, np.ndarray]) -> str:
    """Arrays one after another, each on a multiple of 64 bytes, behind a fixed-size directory."""
    at, entries = 4096, {}
    for name, values in sections.items():
        entries[name] = [values.dtype.str, at, len(values)]
        at += -(-values.nbytes // 64) * 64
    uri, stream = write_file(folder, stem, ".trie")
    stream.write(json.dumps(entries).encode().ljust(4096))
    for values in sections.values():
        stream.write(values.tobytes().ljust(-(-values.nbytes // 64) * 64, b"\0"))
    stream.close()
    return uri


def load(uri: str) -> dict[str, np.ndarray]:
    data = mapped(uri)
    entries = json.loads(data[:4096].tobytes())
    return {name: data[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in entries.items()}


class Opened:
    """The files a task has mapped; the least recently used go first."""

    def __init__(self, make):
        self.make, self.files = make, OrderedDict()

    def __getitem__(self, uri: str):
        if uri not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)
            self.files[uri] = self.make(load(uri))
        self.files.move_to_end(uri)
        return self.files[uri]


# --- Level 1 ------------------------------------------------------------------------------------


def tokens_of(text: str) -> list[bytes]:
    return lowered(text).split()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, end in blocks_of(texts, BLOCK_CHARS):
            yield batch.slice(first, end - first), [tokens_of(t) for t in texts[first:end]]


def token_counts(rows: DataFrame) -> DataFrame:
    """``h long, c long`` of all tokens, the ends included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in _blocks(batches):
            counts = Counter(chain.from_iterable(docs))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(hashes, np.uint64(END)).view(np.int64)), pa.array([*counts.values(), len(docs)], pa.int64())],
                names=["h", "c"])

    return rows.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


_VOCABULARY = "file int, uri string, n long, total long, cuts array<struct<word:long,part:int,of:int>>"


def _cuts(counts: np.ndarray, file_tokens: int) -> list[dict]:
    """Where pair files begin inside this vocabulary file; a context of more mass begins several."""
    cuts = [{"word": 0, "part": 0, "of": 1}]
    heavy = np.flatnonzero(counts > file_tokens)
    steps = np.cumsum(np.where(counts > file_tokens, 0, counts)) // file_tokens
    light = np.flatnonzero(np.diff(steps, prepend=0) > 0)
    for word in sorted({*heavy.tolist(), *(heavy + 1).tolist(), *light.tolist()}):
        of = int(-(-counts[word] // file_tokens)) if word < len(counts) and counts[word] > file_tokens else 1
        if word < len(counts):
            cuts += [{"word": word, "part": k, "of": of} for k in range(of)]
    return cuts


def _save_words(folder: str, file_tokens: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], rows["c"].to_numpy(np.int64)[order]
        # the first value is taken off, so that the universe is the file's own range
        sections = elias_fano(hashes - hashes[0], int(hashes[-1] - hashes[0]) + 1)
        sections |= {"counts": counts, "first": hashes[:1]}
        number = int(rows["file"].iloc[0])
        uri = save(folder, f"words-{number:06d}", sections)
        return pd.DataFrame([(number, uri, len(counts), int(counts.sum()), _cuts(counts, file_tokens))],
                            columns=["file", "uri", "n", "total", "cuts"])

    return build


class _Words:
    def __init__(self, sections):
        self.hashes, self.counts, self.first = EliasFano(sections), sections["counts"], int(sections["first"][0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        span = hashes - np.uint64(self.first)  # smaller hashes wrap around to large values
        inside = (hashes >= np.uint64(self.first)) & ((span >> np.uint64(self.hashes.low_bits)) < len(self.hashes.zeros) * 64)
        inside[inside] &= (span[inside] >> np.uint64(self.hashes.low_bits)).astype(np.int64) < int(self.hashes.zeros[-1]) - 1
        out = np.full(len(hashes), -1, np.int64)
        out[inside] = self.hashes.find(span[inside])
        return out


@dataclass
class Vocabulary:
    bits: int
    files: dict[int, tuple[str, int]]
    size: int
    total: int

    def opened(self) -> VocabularyReader:
        return VocabularyReader(self)


class VocabularyReader:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.open, self.known = vocabulary, Opened(_Words), {}
        self.numbers = np.array(sorted(vocabulary.files), np.int64)
        self.bases = np.array([vocabulary.files[k][1] for k in self.numbers.tolist()], np.int64)

    def _file(self, k: int) -> _Words:
        return self.open[self.v.files[k][0]]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of token hashes, -1 for unseen ones."""
        out = np.full(len(hashes), -1, np.int64)
        file = (hashes >> np.uint64(64 - self.v.bits)).astype(np.int64) if self.v.bits else np.zeros(len(hashes), np.int64)
        for k in np.unique(file).tolist():
            if k in self.v.files:
                at = np.flatnonzero(file == k)
                found = self._file(k).find(hashes[at])
                out[at] = np.where(found >= 0, found + self.v.files[k][1], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        seen = np.flatnonzero(ids >= 0)
        owner = np.searchsorted(self.bases, ids[seen], "right") - 1
        for k in np.unique(owner).tolist():
            at = seen[owner == k]
            out[at] = self._file(int(self.numbers[k])).counts[ids[at] - self.bases[k]]
        return out

    def of_docs(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ends of the documents, ids of their tokens, each document's end included)."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        fresh = list(set().union(*docs).difference(known))
        if b" " not in known:
            known[b" "] = int(self.ids(np.array([END], np.uint64))[0])
        ids = self.ids(np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh)))
        known.update(zip(fresh, ids.tolist(), strict=True))
        get, end = known.__getitem__, (b" ",)
        rows = [np.fromiter(map(get, chain(doc, end)), np.int64, len(doc) + 1) for doc in docs]
        return np.cumsum([0, *map(len, rows)]), np.concatenate(rows) if rows else np.empty(0, np.int64)


def build_vocabulary(rows: DataFrame, folder: str, file_words: int, file_tokens: int) -> tuple[Vocabulary, list[int]]:
    """The vocabulary and the first pair keys of the pair files."""
    counts = written(token_counts(rows), "lm-counts")
    bits = max(0, (counts.count() // file_words)).bit_length()
    file = (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("int")
    made = written(counts.withColumn("file", file).groupBy("file").applyInPandas(
        _save_words(folder, file_tokens), _VOCABULARY), "lm-vocabulary")
    files, base, total, cuts = {}, 0, 0, []
    for r in sorted(made.collect(), key=lambda r: r["file"]):  # one short row a file
        files[r["file"]] = (r["uri"], base)
        cuts += [(base + c["word"], c["part"], c["of"]) for c in r["cuts"]]
        base, total = base + r["n"], total + r["total"]
    if base**2 >= 2**63:
        raise ValueError("more than 3e9 distinct words: pair keys do not fit 63 bits")
    starts = sorted({word * base + base * part // of for word, part, of in cuts})
    return Vocabulary(bits, files, base, total), starts


# --- Level 2 ------------------------------------------------------------------------------------


def _press(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their gaps, with byte planes of the counts."""
    gaps = np.diff(keys, prepend=np.int64(0)).astype("<u8")
    planes = np.concatenate([gaps.view(np.uint8).reshape(-1, 8).T.ravel(),
                             counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(planes) // 12
    gaps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps.astype(np.int64)), counts.astype(np.int64)


def _pairs(ends: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the tokens that follow another, pair keys); a document's first token follows none."""
    follows = np.ones(len(ids), bool)
    follows[ends[:-1]] = False
    at = np.flatnonzero(follows)
    return at, ids[at - 1] * size + ids[at]


def pair_counts(rows: DataFrame, vocabulary: Vocabulary, starts: list[int]) -> DataFrame:
    """``file int, data binary``: a block's distinct pairs, cut by pair file."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((vocabulary, np.array(starts, np.int64)))  # a few numbers a file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, starts = sent.value
        words = vocabulary.opened()
        for _, docs in _blocks(batches):
            _, keys = _pairs(*words.of_docs(docs), vocabulary.size)
            keys, counts = np.unique(keys, return_counts=True)
            ends = np.append(np.searchsorted(keys, starts), len(keys))
            files = np.flatnonzero(np.diff(ends))
            data = [_press(keys[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]) for k in files]
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.int32()), pa.array(data, pa.binary())], names=["file", "data"])

    return rows.mapInArrow(run, "file int, data binary")


def _codes(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code book of ``CODES`` values at most, codes): all values if they are few, else the weighted means of shares of
    equal weight, so that the training text keeps its mean."""
    book, place = np.unique(values, return_inverse=True)
    if len(book) > CODES:
        mass = np.bincount(place, weights)
        owner = np.minimum((np.cumsum(mass) - mass / 2) * CODES / mass.sum(), CODES - 1).astype(np.int64)
        sums, sizes = np.bincount(owner, book * mass, CODES), np.bincount(owner, mass, CODES)
        return np.divide(sums, sizes, out=np.zeros(CODES), where=sizes > 0), owner[place].astype(np.uint16)
    return book, place.astype(np.uint16)


def build_pairs(rows: DataFrame, vocabulary: Vocabulary, starts: list[int], folder: str, discount: float) -> dict[int, str]:
    """The pair files by number."""
    size = vocabulary.size

    def build(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpress(bytes(x)) for x in group["data"]]
        keys, owner = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(owner, np.concatenate([c for _, c in parts])).astype(np.int64)
        number = int(group["file"].iloc[0])
        low = int(keys[0]) // size
        context = keys // size - low
        n = int(context[-1]) + 1
        of_context = vocabulary.opened().counts(keys // size)
        book, codes = _codes(np.log10((counts - discount) / of_context), counts)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=n))])
        sections = {"codes": codes, "book": book, "range": np.array([low, n], np.int64)}
        for name, part in (("child_", elias_fano(keys - low * size, n * size)),
                           ("pointer_", elias_fano(pointers, int(pointers[-1]) + 1))):
            sections |= {name + k: v for k, v in part.items()}
        return pd.DataFrame({"file": [number], "uri": [save(folder, f"pairs-{number:06d}", sections)]})

    made = pair_counts(rows, vocabulary, starts).groupBy("file").applyInPandas(build, "file int, uri string")
    return {r["file"]: r["uri"] for r in written(made, "lm-pairs").collect()}  # one short row a file


class _Pairs:
    def __init__(self, sections):
        self.children, self.pointers = EliasFano(sections, "child_"), EliasFano(sections, "pointer_")
        self.codes, self.book = sections["codes"], sections["book"]
        self.low, self.n = (int(x) for x in sections["range"])

    def followers(self, contexts: np.ndarray) -> np.ndarray:
        at = contexts - self.low
        out, own = np.zeros(len(at), np.int64), (at >= 0) & (at < self.n)
        out[own] = (self.pointers.access(at[own] + 1) - self.pointers.access(at[own])).astype(np.int64)
        return out

    def discounted(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Discounted probabilities, 0 for pairs that the level lacks."""
        relative = keys - self.low * size
        own = (relative >= 0) & (relative < self.n * size)
        place = np.full(len(keys), -1, np.int64)
        place[own] = self.children.find(relative[own])
        return np.where(place >= 0, 10.0 ** self.book[self.codes[np.maximum(place, 0)]], 0.0)


# --- The model ----------------------------------------------------------------------------------


@dataclass
class Trie:
    vocabulary: Vocabulary
    starts: list[int]
    pairs: dict[int, str]
    discount: float


def train(
    docs: DataFrame, text_col: str = "text", discount: float = DISCOUNT,
    file_words: int = FILE_WORDS, file_tokens: int = FILE_TOKENS,
) -> Trie:
    """The model of all the given texts."""
    folder = new_folder(docs.sparkSession, "trie")
    rows = docs.select(whole_text(text_col).alias("text"))
    vocabulary, starts = build_vocabulary(rows, folder, file_words, file_tokens)
    pairs = build_pairs(rows, vocabulary, starts, folder, discount) if vocabulary.size else {}
    return Trie(vocabulary, starts, pairs, discount)


class Scorer:
    def __init__(self, trie: Trie):
        self.trie, self.words, self.open = trie, trie.vocabulary.opened(), Opened(_Pairs)
        self.starts = np.array(trie.starts, np.int64)

    def _by_file(self, keys: np.ndarray) -> Iterator[tuple[_Pairs, slice]]:
        """The pair files of sorted keys."""
        ends = np.append(np.searchsorted(keys, self.starts), len(keys))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            if k in self.trie.pairs:
                yield self.open[self.trie.pairs[k]], slice(ends[k], ends[k + 1])

    def _followers(self, contexts: np.ndarray) -> np.ndarray:
        out, size = np.zeros(len(contexts), np.int64), self.trie.vocabulary.size
        firsts = np.searchsorted(self.starts, contexts * size, "right") - 1
        lasts = np.searchsorted(self.starts, contexts * size + size - 1, "right") - 1
        for k in np.unique(firsts).tolist():
            if k in self.trie.pairs:
                at = np.flatnonzero(firsts == k)
                out[at] += self.open[self.trie.pairs[k]].followers(contexts[at])
        for i in np.flatnonzero(lasts > firsts).tolist():  # contexts that several files share
            for k in range(firsts[i] + 1, lasts[i] + 1):
                if k in self.trie.pairs:
                    out[i] += self.open[self.trie.pairs[k]].followers(contexts[i : i + 1])[0]
        return out

    def score(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, unigram and model log10 probability) of each document."""
        v = self.trie.vocabulary
        ends, ids = self.words.of_docs(docs)
        distinct, inverse = np.unique(ids, return_inverse=True)
        of_distinct = self.words.counts(distinct)
        counts = of_distinct[inverse]
        single = (counts + 0.5) / (v.total + 0.5 * (v.size + 1))
        model = single.copy()
        at, keys = _pairs(ends, ids, v.size)
        seen = (ids[at] >= 0) & (ids[at - 1] >= 0)
        known, order = np.unique(keys[seen], return_inverse=True)
        found = np.zeros(len(known))
        for file, part in self._by_file(known):
            found[part] = file.discounted(known[part], v.size)
        direct = np.zeros(len(at))
        direct[seen] = found[order]
        # the mass that the context's discounts leave
        left = np.zeros(len(distinct))
        words = np.flatnonzero(distinct >= 0)
        left[words] = self.trie.discount * self._followers(distinct[words]) / np.maximum(of_distinct[words], 1)
        of_context = left[inverse[at - 1]]
        backed = of_context > 0
        model[at] = np.where(backed, direct + of_context * single[at], single[at])
        sums = [np.add.reduceat(x, ends[:-1]) if len(docs) else x for x in
                ((counts > 0).astype(np.int64), np.log10(single), np.log10(model))]
        return np.diff(ends), *sums


def score(docs: DataFrame, trie: Trie, text_col: str = "text") -> DataFrame:
    """The documents with ``n_tokens, n_known, base_score, score``."""
    names = ["n_tokens", "n_known", "base_score", "score"]
    carried = [c for c in docs.columns if c not in names]
    schema = with_fields(docs.select(*carried).schema, "n_tokens long, n_known long, base_score double, score double")
    sent = docs.sparkSession.sparkContext.broadcast(trie)  # file names and ranges only

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            for first, end in blocks_of(texts, BLOCK_CHARS):
                found = scorer.score([tokens_of(t) for t in texts[first:end]])
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in carried), *(pa.array(x) for x in found)], names=[*carried, *names])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the checksum of its id's text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), F.lit(5)) == 1
