"""Text classes, written intermediate tables and files in the shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import scratch_path

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def lowered(text: str) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; ``bytes.lower`` leaves all other characters alone."""
    return text.encode("utf-8", "surrogatepass").lower()


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema with the columns of a DDL text behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def written(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and lost executors cost no replay."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Write options for rows of large, already packed values: one codec buffer less, and a page ends with the row that fills it.
PACKED = {"compression": "none", "parquet.page.size.row.check.min": "1"}


@contextmanager
def small_batches(spark: SparkSession, batch_bytes: int = 1 << 20) -> Iterator[None]:
    """Jobs run inside send rows to Python in batches of about ``batch_bytes``.

    An executor builds each batch outside its heap, several times over; the C allocator keeps freed buffers of up to
    32 MB for every thread that had one, so with large batches a long job's memory grows far beyond what is in use.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(batch_bytes))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# --- Files in the shared folder, opened by tasks ------------------------------------------------


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for files that tasks write."""
    folder = scratch_path(spark, name)
    if not urlparse(folder).scheme:
        folder = f"file://{os.path.abspath(folder)}"
    filesystem, path = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    return folder


def write_file(folder: str, stem: str, suffix: str):
    """(uri, open stream) of a file that no other attempt of the task shares.

    Readers take file names from the rows that the finished task returned, so what a failed
    attempt left behind is never read.
    """
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    filesystem, path = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    return uri, filesystem.open_output_stream(path, compression=None)


def read_file(uri: str):
    """A seekable input of a file in the shared folder."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(path)


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the shared folder is mounted, read otherwise."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return np.memmap(unquote(parsed.path), dtype=np.uint8, mode="r")
    with read_file(uri) as source:
        return np.frombuffer(source.read(), dtype=np.uint8)


# --- Hashing in numpy ---------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
