"""Joins that stay balanced when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8
_SALT = "__salt"


def attach_by_group(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join per-group values onto rows, splitting every group over ``salts`` tasks.

    ``stats`` holds at most one row per group, so repeating it ``salts`` times is cheap; a hot
    group's rows no longer meet in one task. There is no broadcast hint: the adaptive planner
    broadcasts ``stats`` by itself when its measured size is under the configured limit. ``salts``
    is a power of two: masking a hash is never null, so no null check on the salt is added to the
    plan below an aggregation that other branches share.
    """
    salted_rows = rows.withColumn(_SALT, F.xxhash64(*spread_on).bitwiseAND(F.lit(salts - 1)))
    salted_stats = stats.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted_rows.join(salted_stats, [*keys, _SALT], how).drop(_SALT)
