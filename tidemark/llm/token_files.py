"""Token ids in files of bit planes.

A file holds the ids of a run of documents in ascending document order, cut into blocks of a fixed number of ids.
A block is transposed into bit planes, as many as its largest id has bits; every plane is compressed by itself
with zstandard. The footer holds the chunk index (offset, ids and width of each block) and the documents' lengths,
so that any run of ids is read by opening the blocks that hold it.

Defined results: a null or empty text has only the end id. Rows are ordered by id, null first, then by text, so
repeated rows stand side by side and have starts of their own. An empty table gives no files. Columns besides id
and text are not stored.
"""

from __future__ import annotations

import io
import json
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import Known, runs_of
from tidemark.llm.common import new_folder, read_file, whole_text, write_file, written

MAGIC = b"BITPLANE"
BLOCK_IDS, FILE_IDS = 65_536, 64 << 20
#: Code points encoded at once, bytes of words and of their remainders that a worker remembers, ids read at once.
BLOCK_CHARS, KNOWN_BYTES, READ_IDS = 4_000_000, 192_000_000, 4 << 20
#: Words of letters that go to the library in one text.
TOGETHER = 100
MANIFEST = "part int, seq int, uri string, n_docs long, n_ids long"


# --- The file format ----------------------------------------------------------------------------


def pack_block(ids: np.ndarray) -> bytes:
    width = int(ids.max()).bit_length() if len(ids) else 0
    press = zstandard.ZstdCompressor(level=3)
    planes = [press.compress(np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes()) for b in range(width)]
    return struct.pack(f"<IB{width}I", len(ids), width, *map(len, planes)) + b"".join(planes)


def unpack_block(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    sizes = struct.unpack_from(f"<{width}I", data, 5)
    at, ids, press = 5 + 4 * width, np.zeros(n, np.uint32), zstandard.ZstdDecompressor()
    for b, size in enumerate(sizes):
        bits = np.unpackbits(np.frombuffer(press.decompress(data[at : at + size]), np.uint8), count=n)
        ids |= bits.astype(np.uint32) << np.uint32(b)
        at += size
    return ids


class TokenFileWriter:
    def __init__(self, stream, block_ids: int = BLOCK_IDS):
        self.stream, self.block_ids = stream, block_ids
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.chunks: list[tuple[int, int]] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for first in range(0, stop, self.block_ids):
            data = pack_block(ids[first : first + self.block_ids])
            self.stream.write(data)
            self.chunks.append((self.at, len(data)))
            self.at += len(data)
        self.waiting, self.n_waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        parts = [
            json.dumps({"block_ids": self.block_ids, "n_ids": self.n_ids, "n_docs": len(self.doc_ids),
                        "n_chunks": len(self.chunks)}).encode(),
            np.array(self.chunks, "<u8").tobytes(), known.tobytes(),
            np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(), np.array(self.lengths, "<u8").tobytes(),
        ]
        footer = zstandard.ZstdCompressor().compress(
            struct.pack("<5Q", *map(len, parts)) + b"".join(parts))
        self.stream.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.stream.close()


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END)
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("no bit-plane file")
        (size,) = struct.unpack("<Q", tail[:8])
        source.seek(end - 16 - size)
        raw = zstandard.ZstdDecompressor().decompress(source.read(size))
        ends = np.cumsum((40, *struct.unpack_from("<5Q", raw))).tolist()
        head, chunks, known, doc_ids, lengths = (raw[a:b] for a, b in zip(ends, ends[1:], strict=False))
        self.meta = json.loads(head)
        self.chunks = np.frombuffer(chunks, "<u8").reshape(-1, 2)
        self.known = np.frombuffer(known, np.uint8).astype(bool)
        self.doc_ids = np.frombuffer(doc_ids, "<i8")
        self.lengths = np.frombuffer(lengths, "<u8").astype(np.int64)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids first..end of the file; opens only the blocks that hold them."""
        if end <= first:
            return np.empty(0, np.uint32)
        size = self.meta["block_ids"]
        blocks = []
        for at, length in self.chunks[first // size : -(-end // size)].tolist():
            self.source.seek(at)
            blocks.append(unpack_block(self.source.read(length)))
        skipped = first // size * size
        return np.concatenate(blocks)[first - skipped : end - skipped]


# --- Encoding -----------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _stem(word: str) -> tuple[str, str]:
    """(word, stops and commas behind it); words of A-Z and a-z in small letters."""
    stem = word.rstrip(".,")
    if stem.isascii():
        if stem.isalpha():
            return stem.lower(), word[len(stem):]
        return (stem, word[len(stem):]) if stem[-1:].isalnum() else (word, "")
    # a last letter whose small form ends in a mark would take the stops into its own piece
    return (stem, word[len(stem):]) if stem[-1].lower().isalnum() else (word, "")


class WordEncoder:
    """Ids of whole texts from ids of words.

    The vocabulary drops white space and merges inside words only, so a text's ids are those of its parts between
    spaces and line feeds, one after another. A part that ends in a letter or digit and stops or commas splits there,
    as the vocabulary's own pattern does, and A-Z are its small letters. Every distinct remainder goes to the library
    once, however its parts are written. Arrow cuts a block's texts and numbers its distinct parts, which are looked up
    once a block; numpy lays their ids end to end. A Python worker keeps what it knows for its next task.
    """

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        self.tokenizer = _tokenizer(path)
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[x for token, x in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known, self.stems = Known(known_bytes), Known(known_bytes)

    def _library(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn_stems(self, stems: list[str]) -> None:
        plain, alone = [], []
        for x in stems:
            (plain if (x if x.isascii() else x.lower()).isalpha() else alone).append(x)
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, found in zip(groups, self._library([" ".join(g) for g in groups]), strict=True):
            # words of letters are one piece each, and a piece's last id carries the vocabulary's mark
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(group):
                alone += group
                continue
            data = ids.tobytes()
            self.stems.update(group, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        self.stems.update(alone, [np.array(found.ids, "<u4").tobytes() for found in self._library(alone)])

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        fresh = self.known.missing(set(words))
        cuts = [_stem(word) for word in fresh]
        self._learn_stems(self.stems.missing({x for cut in cuts for x in cut}))
        get = self.stems.new.__getitem__
        self.known.update(fresh, [get(stem) + get(rest) if rest else get(stem) for stem, rest in cuts])
        return list(map(self.known.new.__getitem__, words))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends of the texts' ids, ids of all texts), with the end id behind each text."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        parts = split.flatten().dictionary_encode()
        found = self._words(parts.dictionary.to_pylist())
        found.append(struct.pack("<I", end_id))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths
        # which word stands where, the end id behind the last one of each text
        counts = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words = np.insert(parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, len(found) - 1)
        sizes = lengths[words]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        places = np.repeat((first[words] - ends + sizes).astype(kind), sizes)
        places += np.arange(total, dtype=kind)
        return ends[counts + np.arange(len(counts))], flat[places]


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files and returns their manifest, a written table; (part, seq) is the order of the files."""
    folder = new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text").select(
        F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, uri, seq, done = _encoder(tokenizer_path), None, "", 0, []
        part = 0

        def close():
            writer.close()
            done.append((part, seq, uri, len(writer.lengths), writer.n_ids))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            doc_ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for first, end in runs_of(pc.utf8_length(texts).to_pylist(), BLOCK_CHARS):
                ends, ids = encoder.encode(texts.slice(first, end - first), end_id)
                ends = ends.tolist()
                for doc_id, x, y in zip(doc_ids[first:end], [0, *ends], ends, strict=False):
                    if writer is None:
                        uri, stream = write_file(folder, f"part-{part:06d}-{seq:04d}", ".bitplanes")
                        writer = TokenFileWriter(stream, block_ids)
                    writer.add(doc_id, ids[x:y])
                    if writer.n_ids >= file_ids:
                        close()
                        writer, seq = None, seq + 1
        if writer is not None:
            close()
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)],
                names=[c.split()[0] for c in MANIFEST.split(", ")])

    return written(ordered.mapInArrow(run, MANIFEST), "token-manifest")


# --- Reading ------------------------------------------------------------------------------------


def read_tokens(manifest: DataFrame, stretch_docs: int = 4096) -> DataFrame:
    """``doc_id long, start long, ids binary`` (little-endian unsigned 32-bit) from the files.

    What stands before a file is the sum of the parts before its own and of its part's earlier files, so no task sees
    more than a row a part or the files of one part. Long files are read in stretches of documents by several tasks.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # one task sorts these rows, one a partition of the write
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    stretches = F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(stretch_docs).cast("long"))
    dealt = manifest.withColumn("within", within).join(before, "part").select(
        "uri", (F.col("before") + F.col("within")).alias("start"), F.explode(stretches).alias("first_doc"),
    ).repartition("uri", "first_doc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with read_file(row["uri"]) as source:
                    file = TokenFile(source)
                    ends = np.concatenate([[0], np.cumsum(file.lengths)])
                    at, stop = row["first_doc"], min(row["first_doc"] + stretch_docs, len(file.lengths))
                    while at < stop:
                        # whole documents, READ_IDS ids or one document at a time
                        upto = max(at + 1, min(stop, int(np.searchsorted(ends, ends[at] + READ_IDS, "right")) - 1))
                        ids, base = file.ids(int(ends[at]), int(ends[upto])), ends[at]
                        data = [ids[ends[d] - base : ends[d + 1] - base].astype("<u4").tobytes() for d in range(at, upto)]
                        names = pa.array(file.doc_ids[at:upto], pa.int64(), mask=~file.known[at:upto])
                        yield pa.RecordBatch.from_arrays(
                            [names, pa.array(ends[at:upto] + row["start"], pa.int64()), pa.array(data, pa.binary())],
                            names=["doc_id", "start", "ids"])
                        at = upto

    return dealt.mapInArrow(run, "doc_id long, start long, ids binary")
