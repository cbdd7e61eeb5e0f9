"""The corpus pipeline: five of the package's operators, each on what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, line_dedup, near_dups, quality
from tidemark.llm.common import table, written
from tidemark.llm.queries import RANKS, trusted_ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    found = quality.quality_rules(docs, trusted_ids(spark, sf_dir))
    return found.filter("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one of the largest id; a text may become empty, no document goes."""
    return line_dedup.line_dedup(docs).withColumn("text", F.col("kept_text")).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of its repeated rows all do."""
    kept = near_dups.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that is mostly such passages goes."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    mostly = F.col("n_hit") > decontamination.MAX_SHARE * F.col("n_words")
    return found.filter(~mostly).withColumn("text", F.when(F.col("contaminated"), F.col("clean_text")).otherwise(
        F.col("text"))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, the number of them and the text that the ids decode to."""
    path = public_tokenizers.path(RANKS)
    rows = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return rows.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded": F.col("decoded").cast("string")})


STAGES = [
    ("quality rules", quality_rules), ("line dedup", drop_repeated_lines), ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate), ("byte-level BPE", encode),
]
#: The quality model and the ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
