"""Itemsets as sorted string arrays, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SPACES = " \t\n\x0b\x0c\r"


def itemset_text(items: Column) -> Column:
    return F.array_join(F.sort_array(items), " AND ")


def split_items(text: Column) -> Column:
    """Stored itemset text back to tags; also reads ``frozenset({...})`` text and commas."""
    s = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    inner = F.regexp_extract(s, r"(?s)\{(.*)\}", 1)
    parts = F.when(s.startswith("frozenset"), F.split(inner, ",")).otherwise(
        F.split(s, r"\s+AND\s+|,\s*")
    )
    bare = F.transform(parts, lambda p: F.regexp_replace(F.btrim(p, F.lit(SPACES)), r"""^['"]+|['"]+$""", ""))
    return F.filter(bare, lambda p: p != "")


def is_hardware_only(items: Column) -> Column:
    return F.forall(items, lambda i: i.startswith("hw_"))
