"""Saved pages of raw JSON, exploded to one row per review or per player observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.reviews import review_columns
from tidemark.schemas import RAW_PLAYER_PAGE, RAW_REVIEW_PAGE


def read_review_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per raw review: ``app_id`` and the struct ``raw``."""
    pages = spark.read.schema(RAW_REVIEW_PAGE).json(path)
    return explode_reviews(pages)


def explode_reviews(pages: DataFrame) -> DataFrame:
    return pages.select("app_id", F.explode("reviews").alias("raw"))


def flatten_reviews(raw: DataFrame, as_of: int) -> DataFrame:
    """Typed columns with defaults; ``as_of`` (epoch seconds) stands in for a missing update time."""
    return raw.select("app_id", *review_columns(F.col("raw"), F.lit(as_of).cast("long")))


def read_player_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per observation: ``app_id, players, added``."""
    pages = spark.read.schema(RAW_PLAYER_PAGE).json(path)
    return explode_players(pages)


def explode_players(pages: DataFrame) -> DataFrame:
    return pages.select("app_id", F.explode("history").alias("h")).select("app_id", "h.players", "h.added")
