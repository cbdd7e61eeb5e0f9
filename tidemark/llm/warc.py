"""WARC archives with a two-level capture index.

Writing: every page becomes a gzip member of its own in an archive in the shared folder. Of equal payloads the one
with the smallest page id is a ``response``; the others are ``revisit`` records that name it and carry no payload.
Index: the captures, sorted by reversed-host URL key over the whole corpus, are cut into compressed blocks; the
directory holds the first and last key of each block only. Reading: a look-up binary-searches the directory, opens
one or few blocks, binary-searches those and reads the byte ranges they name. Reading everything walks the blocks
and merges neighbouring ranges of an archive into long reads.

Defined results: a null html is an empty payload, a null url an empty one. Rows that share the smallest id of their
payload are all responses; if no copy has an id, all copies are. A payload with an id always precedes copies without
one. Control characters and spaces in a url are percent-encoded in the archive's header only. Other columns of the
input are not archived. An empty table gives no archive and an empty index.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, LOWER, new_folder, read_file, write_file, written
from tidemark.skew import attach_by_group

MIN_REVISIT_BYTES = 100
#: Payload bytes in an archive, captures in an index block, bytes of one merged read.
ARCHIVE_BYTES, BLOCK_CAPTURES, READ_BYTES = 256 << 20, 3000, 4 << 20
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "urlkey string, page_id long, record_type string, archive string, offset long, length long"
BLOCK = "part int, block int, first_key string, last_key string, n long, data binary"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host's labels reversed, A-Z lower-cased, then the rest of the url."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"^[^:/?#]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


# --- Records ------------------------------------------------------------------------------------


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    safe = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        headers += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _urn(value: str) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?[0-9]*)>", value)[1]
    return int(number) if number else None


def parse_record(member: bytes) -> dict:
    """One gzip member as a row; the digest of a response is taken from its payload and must match its header."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _urn(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size,
        "payload_digest": digest, "record_type": kind,
        "refers_to": _urn(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as columns; whole numbers stay whole beside nulls."""
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pd.DataFrame({name: pd.array(list(values), dtype="Int64") if kind in ("long", "int") else pd.Series(list(values), dtype=object)
                         for (name, kind), values in zip(fields, columns, strict=True)})


# --- Writing ------------------------------------------------------------------------------------


def with_first_copy(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, urlkey, payload, digest, refers_to``; the last is null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        url_key(F.col("url")).alias("urlkey"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    firsts = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter(
        "n > 1 AND first IS NOT NULL").drop("n")
    # only payloads that occur again have a row in firsts; the salted join keeps a hot payload off one task
    joined = attach_by_group(rows, firsts, ["digest"], ["page_id", "url"], how="left")
    again = F.col("first").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their captures, unsorted."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = uri = None
        size = offset = 0
        for batch in batches:
            rows = []
            for page_id, url, key, payload, digest, first in zip(
                batch["page_id"], batch["url"], batch["urlkey"], batch["payload"], batch["digest"],
                batch["refers_to"], strict=True,
            ):
                if stream is None:
                    uri, stream = write_file(folder, "pages", ".warc.gz")
                    size = offset = 0
                page_id = None if pd.isna(page_id) else int(page_id)
                member = _record(page_id, url, bytes(payload), digest, None if pd.isna(first) else int(first))
                stream.write(member)
                rows.append((key, page_id, "response" if pd.isna(first) else "revisit", uri, offset, len(member)))
                offset, size = offset + len(member), size + len(payload)
                if size >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            yield _frame(rows, CAPTURE)
        if stream is not None:
            stream.close()

    # 64-bit ids survive pandas as nullable integers only
    rows = with_first_copy(pages).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return rows.mapInPandas(write, CAPTURE)


# --- Index --------------------------------------------------------------------------------------


def _encode(rows: list[tuple]) -> bytes:
    """Captures of one block: keys share their prefixes with the key before, all of it compressed."""
    out, last = [struct.pack("<I", len(rows))], b""
    for key, page_id, kind, archive, offset, length in rows:
        key, archive = key.encode(), archive.encode()
        same = 0
        for a, b in zip(key, last, strict=False):
            if a != b:
                break
            same += 1
        out.append(struct.pack("<IIHB?qqq", same, len(key) - same, len(archive), kind == "revisit",
                               page_id is not None, page_id or 0, offset, length))
        out += [key[same:], archive]
        last = key
    return zlib.compress(b"".join(out), 6)


def decode_block(data: bytes) -> list[tuple]:
    raw = zlib.decompress(data)
    (n,), at, last, rows = struct.unpack_from("<I", raw), 4, b"", []
    for _ in range(n):
        same, more, name, revisit, known, page_id, offset, length = struct.unpack_from("<IIHB?qqq", raw, at)
        at += struct.calcsize("<IIHB?qqq")
        last = last[:same] + raw[at : at + more]
        archive = raw[at + more : at + more + name].decode()
        at += more + name
        rows.append((last.decode(), page_id if known else None, "revisit" if revisit else "response", archive, offset, length))
    return rows


def _blocks(block_captures: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, number = [], 0

        def block(rows):
            return _frame([(rows[0][7], number, rows[0][0], rows[-1][0], len(rows), _encode([r[:6] for r in rows]))], BLOCK)

        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"]]
            waiting += zip(batch["urlkey"], ids, batch["record_type"], batch["archive"], batch["offset"],
                           batch["length"], batch["place"], batch["part"], strict=True)
            while len(waiting) >= block_captures:
                yield block(waiting[:block_captures])
                waiting, number = waiting[block_captures:], number + 1
        if waiting:
            yield block(waiting)

    return cut


@dataclass
class CaptureIndex:
    """Sorted, compressed blocks of captures; ``blocks`` is a table, the directory its narrow columns."""

    blocks: DataFrame
    captures: DataFrame

    def directory(self) -> DataFrame:
        return self.blocks.select("first_key", "last_key", "part", "block", "n")

    def all_captures(self) -> DataFrame:
        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for data in batch["data"]:
                    yield _frame(decode_block(data), CAPTURE)

        return self.blocks.select("data").mapInPandas(decode, CAPTURE)

    def look_up(self, urls: list[str]) -> DataFrame:
        """Captures of a few urls. Spark reads the directory's statistics for the blocks whose key range holds a
        wanted key; each of those is binary-searched."""
        spark = self.blocks.sparkSession
        if not urls:
            return spark.createDataFrame([], CAPTURE)
        wanted = sorted(r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(
            url_key(F.col("url"))).distinct().collect())

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first, last, data in zip(batch["first_key"], batch["last_key"], batch["data"], strict=True):
                    own = wanted[bisect.bisect_left(wanted, first) : bisect.bisect_right(wanted, last)]
                    if not own:
                        continue
                    rows = decode_block(data)
                    found = []
                    for key in own:
                        at = bisect.bisect_left(rows, key, key=lambda r: r[0])
                        while at < len(rows) and rows[at][0] == key:
                            found.append(rows[at])
                            at += 1
                    yield _frame(found, CAPTURE)

        # the range of wanted keys is pushed to the Parquet row groups, which are sorted
        near = self.blocks.filter((F.col("first_key") <= wanted[-1]) & (F.col("last_key") >= wanted[0]))
        return near.select("first_key", "last_key", "data").mapInPandas(search, CAPTURE)


def build_index(captures: DataFrame, block_captures: int = BLOCK_CAPTURES) -> CaptureIndex:
    """Sorts the captures over the corpus. The archive place breaks ties, so a hot url is spread as well; binary
    string order is the order of the keys' UTF-8."""
    placed = captures.withColumn("place", F.concat_ws(":", "archive", F.lpad(F.col("offset").cast("string"), 20, "0")))
    ranged = placed.repartitionByRange("urlkey", "place").withColumn("part", F.spark_partition_id()).withColumn(
        "page_id", F.col("page_id").cast("string"))
    blocks = ranged.sortWithinPartitions("urlkey", "place").mapInPandas(_blocks(block_captures), BLOCK)
    return CaptureIndex(written(blocks, "capture-blocks"), captures)


def archive(pages: DataFrame, name: str = "archive") -> CaptureIndex:
    """Writes the pages into archives of the shared folder and indexes them."""
    captures = written(write_archives(pages, new_folder(pages.sparkSession, name)), "captures")
    return build_index(captures)


# --- Reading ------------------------------------------------------------------------------------


def _runs(rows: list[tuple[int, int]], read_bytes: int) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring (offset, length) ranges that one read fetches."""
    run: list[tuple[int, int]] = []
    for offset, length in rows:
        if run and (offset != run[-1][0] + run[-1][1] or offset + length - run[0][0] > read_bytes):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read_records(captures: DataFrame, with_payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of the captures, read by byte ranges.

    Captures are dealt by archive and stretch of it, so that one task reads neighbours together and no task gets
    a whole long archive.
    """
    stretch = F.floor(F.col("offset") / F.lit(read_bytes))
    dealt = captures.select("archive", "offset", "length", stretch.alias("stretch")).repartition(
        "archive", "stretch").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, rows in batch.groupby("archive", sort=False):
                with read_file(uri) as source:
                    places = list(zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True))
                    for run in _runs(places, read_bytes):
                        source.seek(run[0][0])
                        data = source.read(run[-1][0] + run[-1][1] - run[0][0])
                        found = [parse_record(data[o - run[0][0] : o - run[0][0] + n]) for o, n in run]
                        if not with_payload:
                            found = [r | {"payload": None} for r in found]
                        yield _frame([tuple(r.values()) for r in found], RECORD)

    return dealt.mapInPandas(read, RECORD)


def read_archive(index: CaptureIndex, with_payload: bool = True) -> DataFrame:
    """Every record that the index names."""
    return read_records(index.all_captures(), with_payload)


def read_urls(spark: SparkSession, index: CaptureIndex, urls: list[str]) -> DataFrame:
    """The records of a few urls: directory, block, range read."""
    return read_records(index.look_up(urls))
