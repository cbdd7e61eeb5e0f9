"""The stored tables: Parquet under one root, in committed batches partitioned by ``app_id``."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schemas import KEYS, TABLES
from tidemark.session import cut_lineage

COMMITS = "seq long, name string, batch string, app_id long"
ROW_GROUP_BYTES = 32 << 20


class Layout(NamedTuple):
    folders: list[str]
    order: list[str]
    looked_up: list[str] = []


LAYOUT = {
    "reviews": Layout(["app_id"], ["timestamp_updated"], ["recommendationid"]),
    "daily_kpis": Layout(["app_id"], ["date"]),
    "mining_runs": Layout(["app_id"], ["timestamp"], ["run_id"]),
    "association_rules": Layout(["app_id", "run_id"], ["lift"]),
    "hyperparameter_tuning": Layout(["app_id"], ["timestamp"]),
}


def first_per_key(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """One row per key, the first in ``order``; the rest of the duplicates is dropped."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def merge_rows(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-replace: of two rows with one key, the new one stays."""
    both = stored.withColumn("__old", F.lit(1)).unionByName(
        new.select(*stored.columns).withColumn("__old", F.lit(0))
    )
    return first_per_key(both, keys, "__old").drop("__old")


def unseen_rows(new: DataFrame, stored: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """Insert-or-ignore: rows whose key is not stored, the first of every key in the batch, by hash without an order.

    Only the key columns of the stored table are read, and only for the apps of the batch.
    """
    known = stored.select(*keys)
    if "app_id" in keys:
        known = known.join(new.select("app_id").distinct(), "app_id", "left_semi")
    fresh = new.join(known, list(keys), "left_anti")
    return first_per_key(fresh, keys, *(order or [F.xxhash64(*fresh.columns)]))


class TableStore:
    """Reads and writes the stored tables below ``root``.

    Every write goes to a folder of its own, ``<table>/batch=<id>/app_id=<app>``, and counts only once the table of
    commits names it. A commit is one small file, so a job that dies before it changes nothing, and one commit may
    replace rows of several tables. No write touches files that a reader holds. One writer at a time; folders that no
    commit names, or that were replaced, stay on disk.
    """

    def __init__(self, spark: SparkSession, root: str, row_group_bytes: int = ROW_GROUP_BYTES):
        self.spark = spark
        self.root = root.rstrip("/")
        self.row_group_bytes = row_group_bytes

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _written(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """The committed rows, or no rows with the table's schema while there are none.

        A row counts if its batch is committed, and not before the last replacement of its app's rows. Both lists are
        small beside the data and prune its folders.
        """
        commits = self._written("commits", COMMITS).filter(F.col("name") == name)
        batches = commits.filter("batch IS NOT NULL").select("batch", "seq")
        replaced = commits.filter("batch IS NULL").groupBy("app_id").agg(F.max("seq").alias("__since"))
        rows = self._written(name, f"{TABLES[name]}, batch string").join(batches, "batch").join(replaced, "app_id", "left")
        return rows.filter("__since IS NULL OR seq >= __since").select(*self._fields(name).names)

    def _fields(self, name: str):
        return self.spark.createDataFrame([], TABLES[name]).schema

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        """Columns and types of the table; absent columns become null, or 0.0 for metrics."""
        columns = []
        for field in self._fields(name):
            if field.name in df.columns:
                value = F.col(field.name)
            elif name == "association_rules" and field.dataType.typeName() == "double":
                value = F.lit(0.0)
            else:
                value = F.lit(None)
            columns.append(value.cast(field.dataType).alias(field.name))
        return df.select(*columns)

    def _write(self, name: str, df: DataFrame) -> str:
        """Writes a batch that no reader sees yet, and returns its id.

        Rebalancing writes few files for a small app and splits the files of a large one. Rows are in the order of time
        inside a file, so statistics of row groups and pages skip what lies outside a span of days; keys that are looked
        up by value get Bloom filters.
        """
        batch = uuid.uuid4().hex
        layout = LAYOUT[name]
        writer = (
            self._shaped(name, df).hint("rebalance", "app_id").sortWithinPartitions(*layout.folders, *layout.order)
            .write.partitionBy(*layout.folders).option("parquet.block.size", self.row_group_bytes)
        )
        for column in layout.looked_up:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path(name)}/batch={batch}")
        return batch

    def _commit(self, batches: Sequence[tuple[str, str]], replaced: Sequence[str] = (), apps: DataFrame | None = None) -> None:
        """Names the batches, and the apps whose earlier rows are gone from the ``replaced`` tables, in one file."""
        last = self._written("commits", COMMITS).agg(F.max("seq")).first()[0]
        seq = 1 + (last or 0)
        rows = self.spark.createDataFrame([(seq, name, batch, None) for name, batch in batches], COMMITS)
        for name in replaced:
            rows = rows.unionByName(apps.select(
                F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("batch"),
                F.col("app_id").cast("long").alias("app_id")))
        rows.coalesce(1).write.mode("append").parquet(self.path("commits"))

    def append(self, name: str, df: DataFrame) -> None:
        self._commit([(name, self._write(name, df))])

    def replace(self, tables: Mapping[str, DataFrame], apps: DataFrame) -> None:
        """In all ``tables`` at once, the rows of ``apps`` (``app_id``) give way to the new rows."""
        apps = cut_lineage(apps.select("app_id").distinct())
        self._commit([(name, self._write(name, df)) for name, df in tables.items()], list(tables), apps)

    def insert_or_ignore(self, name: str, df: DataFrame, *order) -> None:
        """Stored rows stay; the first row of a key in the batch wins. Safe to repeat."""
        keys = ["app_id", *KEYS[name]]
        new = unseen_rows(df, self.read(name), keys, *order)
        self.append(name, new)

    def insert_or_replace(self, name: str, df: DataFrame) -> None:
        """Writes the rows of the apps in ``df`` anew, merged with the new ones; other apps' files stay."""
        keys = ["app_id", *KEYS[name]]
        shaped = cut_lineage(self._shaped(name, df))
        apps = shaped.select("app_id").distinct()
        touched = self.read(name).join(apps, "app_id", "left_semi")
        self.replace({name: merge_rows(touched, shaped, keys)}, apps)

    def clear(self, name: str, app_ids: Sequence[int]) -> None:
        """The rows of the given apps are gone."""
        apps = self.spark.createDataFrame([(int(app_id),) for app_id in app_ids], "app_id long")
        self._commit([], [name], apps)

    def compact(self, name: str) -> None:
        """All rows in one batch, so that many small batches do not pile up."""
        rows = self.read(name)
        self.replace({name: rows}, rows)
