"""Association mining over many groups at once.

A group is whatever the caller names, usually ``app_id`` and a window. Frequent itemsets are
found in two passes over the data however long the itemsets get (the partition method of
Savasere, Omiecinski and Navathe, VLDB 1995):

1. Equal baskets of a group are merged into one weighted row, and each group is cut into blocks
   of bounded size by a hash of the basket. An itemset that is frequent in its group must be
   frequent, relative to the block's share, in at least one block; each block names its own.
2. All blocks count the named itemsets of their group; the sums decide.

A small group is a single block and needs no second pass. No block ever depends on the size of
its group, so a group holding a third of all rows just becomes more blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import islice
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.itemsets import is_hardware_only, itemset_text
from tidemark.schemas import RULE_METRICS
from tidemark.session import cut_lineage
from tidemark.skew import attach_by_group

UNIVERSAL_SHARE = 0.95
MIN_IMPROVEMENT = 0.05
BLOCK_ROWS = 16384
OUTPUT_ROWS = 20000
#: Itemsets or rules of a group in one task; splits held at once there.
CHUNK_ROWS, SPLIT_CELLS = 50000, 1 << 22


def distinct_baskets(baskets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Equal baskets merged: ``group, items`` (sorted), ``weight``; summed partially before the shuffle."""
    ordered = baskets.select(*group, F.sort_array(F.array_distinct("items")).alias("items"))
    return ordered.groupBy(*group, "items").agg(F.count("*").alias("weight"))


def groups_with_enough(baskets: DataFrame, group: Sequence[str], least: int) -> DataFrame:
    """The baskets of groups that have at least ``least`` of them, empty ones included."""
    enough = baskets.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return attach_by_group(baskets, enough, list(group), ["items"]).drop("__n")


def group_sizes(weighted: DataFrame, group: Sequence[str]) -> DataFrame:
    """``n_baskets`` per group, empty baskets included, and ``n_distinct`` of them."""
    return weighted.groupBy(*group).agg(F.sum("weight").alias("n_baskets"), F.count("*").alias("n_distinct"))


def item_counts(weighted: DataFrame, group: Sequence[str]) -> DataFrame:
    return (
        weighted.select(*group, F.explode("items").alias("item"), "weight")
        .groupBy(*group, "item").agg(F.sum("weight").alias("item_count"))
    )


def without_universal(counts: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Item counts that do not exceed 95 % of the group's baskets, rounded down."""
    return attach_by_group(counts, sizes, group, ["item"]).filter(
        F.col("item_count") <= F.floor(F.lit(UNIVERSAL_SHARE) * F.col("n_baskets"))
    )


def min_count(min_support: float) -> Column:
    return F.ceil(F.lit(float(min_support)) * F.col("n_baskets"))


def kept_baskets(
    weighted: DataFrame, sizes: DataFrame, group: Sequence[str], min_support: float
) -> DataFrame:
    """Baskets reduced to items that can occur in a rule, merged again; empty ones are gone.

    A group has at most ``longest basket / min_support`` frequent items, so their array is small.
    """
    items = (
        without_universal(item_counts(weighted, group), sizes, group)
        .filter(F.col("item_count") >= min_count(min_support))
        .groupBy(*group, "n_baskets", "n_distinct").agg(F.collect_list("item").alias("__keep"))
    )
    return (
        attach_by_group(weighted, items, group, ["items"])
        .withColumn("items", F.array_intersect("items", "__keep"))
        .filter(F.size("items") > 0)
        .groupBy(*group, "n_baskets", "n_distinct", "items").agg(F.sum("weight").alias("weight"))
    )


def _as_matrix(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The sorted item names of a block, and per item (row) the baskets (columns) that hold it."""
    lengths = rows.map(len).to_numpy()
    names, item = np.unique(np.concatenate(rows.to_numpy()), return_inverse=True)
    holds = np.zeros((len(names), len(rows)), dtype=bool)
    holds[item, np.repeat(np.arange(len(rows)), lengths)] = True
    return names, holds


def _locally_frequent(block: pd.DataFrame) -> Iterator[tuple[list[str], int]]:
    """Every itemset of the block whose weight reaches the block's share of the group's threshold."""
    names, holds = _as_matrix(block["items"])
    weight = block["weight"].to_numpy(dtype=float)
    needed = block["min_count"].iloc[0] * weight.sum() / block["n_baskets"].iloc[0] - 1e-6

    def grow(prefix: list[str], weight: np.ndarray, holds: np.ndarray, names: np.ndarray):
        counts = holds @ weight
        frequent = np.flatnonzero(counts >= needed)
        for i, item in enumerate(frequent):
            longer = [*prefix, names[item]]
            yield longer, int(counts[item])
            later = frequent[i + 1:]
            if later.size:
                inside = np.flatnonzero(holds[item])
                yield from grow(longer, weight[inside], holds[later].take(inside, axis=1), names[later])

    yield from grow([], weight, holds.astype(float), names)


def _count_in_block(block: pd.DataFrame, named: pd.DataFrame) -> list[int]:
    """Weights of the named itemsets; neighbours in item order share the baskets of their common prefix."""
    names, holds = _as_matrix(block["items"])
    columns = dict(zip(names, holds))
    absent = np.zeros(len(block), dtype=bool)
    weight = block["weight"].to_numpy(dtype=np.int64)
    wanted = [list(items) for items in named["items"]]
    counts, path, inside = np.zeros(len(wanted), dtype=np.int64), [], [~absent]
    for k in sorted(range(len(wanted)), key=wanted.__getitem__):
        shared = 0
        while shared < min(len(path), len(wanted[k])) and path[shared] == wanted[k][shared]:
            shared += 1
        del path[shared:], inside[shared + 1:]
        for item in wanted[k][shared:]:
            path.append(item)
            inside.append(inside[-1] & columns.get(item, absent))
        counts[k] = weight[inside[-1]].sum()
    return counts.tolist()


def frequent_itemsets(
    baskets: DataFrame, group: Sequence[str], min_support: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All itemsets with ``count >= ceil(min_support * n_baskets)`` in their group, of any length.

    Takes ``group, items`` rows; universal items never take part. Returns ``group, items``
    (sorted), ``support_count`` and ``n_baskets``.
    """
    group = list(group)
    weighted = cut_lineage(distinct_baskets(baskets, group))
    sizes = group_sizes(weighted, group)
    # Blocks share the group's threshold by their weight. Empty baskets are in no block, so the
    # shares sum to no more than the threshold and no frequent itemset is missed. Their number follows
    # the reduced baskets: rare items that keep baskets apart are gone by then.
    reduced = cut_lineage(kept_baskets(weighted, sizes, group, min_support).drop("n_distinct"))
    extents = reduced.groupBy(*group).agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("n_blocks"), F.sum("weight").alias("kept_weight")
    )
    blocks = cut_lineage(
        attach_by_group(reduced, extents, group, ["items"])
        .withColumn("block", F.pmod(F.xxhash64("items"), F.col("n_blocks")).cast("int"))
        .withColumn("min_count", min_count(min_support))
    )
    extent = blocks.agg(
        F.count_distinct(*group, "block").alias("blocks"), F.max("n_blocks").alias("largest")
    ).first()
    if not extent["blocks"]:
        return blocks.select(*group, "items", F.col("weight").alias("support_count"), "n_baskets")
    # The work of a block is far larger than its bytes, so blocks are not packed by size.
    partitions = min(extent["blocks"], int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema}
    group_ddl = ", ".join(f"`{g}` {fields[g]}" for g in group)

    measures = ["block_weight", "n_blocks", "kept_weight", "min_count", "n_baskets"]

    def name_itemsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(batches), ignore_index=True)
        constant = {c: block[c].iloc[0] for c in [*group, "n_blocks", "kept_weight", "min_count", "n_baskets"]}
        constant["block_weight"] = int(block["weight"].sum())
        found = _locally_frequent(block)
        while part := list(islice(found, OUTPUT_ROWS)):
            result = pd.DataFrame({"items": [i for i, _ in part], "block_count": [c for _, c in part]})
            yield result.assign(**constant)[[*group, "items", "block_count", *measures]]

    named = cut_lineage(
        blocks.repartition(partitions, *group, "block").groupBy(*group, "block").applyInPandas(
            name_itemsets,
            f"{group_ddl}, items array<string>, block_count long, block_weight long, n_blocks int, kept_weight long, "
            "min_count long, n_baskets long",
        )
    )
    columns = [*group, "items", F.col("block_count").alias("support_count"), "n_baskets"]
    of_one_block = named.filter(
        (F.col("n_blocks") == 1) & (F.col("block_count") >= F.col("min_count"))
    ).select(*columns)
    if extent["largest"] == 1:
        return of_one_block
    of_many = named.filter(F.col("n_blocks") > 1)

    def count_itemsets(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if block.empty or wanted.empty:
            return wanted[[*group, "items", "min_count", "n_baskets"]].assign(block_count=0)
        return wanted[[*group, "items", "min_count", "n_baskets"]].assign(
            block_count=_count_in_block(block, wanted)
        )

    # A block that did not name an itemset holds less of it than the block's share of the threshold.
    most = F.sum("block_count") + F.col("min_count") * (F.col("kept_weight") - F.sum("block_weight")) / F.col("n_baskets")
    wanted = (
        of_many.groupBy(*group, "items", "n_blocks", "kept_weight", "min_count", "n_baskets").agg(most.alias("most"))
        .filter(F.col("most") >= F.col("min_count") - F.lit(1e-3)).drop("most", "kept_weight")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    )
    counted = (
        blocks.filter(F.col("n_blocks") > 1).repartition(partitions, *group, "block").groupBy(*group, "block")
        .cogroup(wanted.repartition(partitions, *group, "block").groupBy(*group, "block"))
        .applyInPandas(
            count_itemsets, f"{group_ddl}, items array<string>, min_count long, n_baskets long, block_count long"
        )
    )
    totals = (
        counted.groupBy(*group, "items", "min_count", "n_baskets")
        .agg(F.sum("block_count").alias("support_count"))
        .filter(F.col("support_count") >= F.col("min_count"))
    )
    return of_one_block.unionByName(totals.select(*of_one_block.columns))


def _confident_splits(itemsets: DataFrame, group: list[str], min_confidence: float) -> DataFrame:
    """``group, items, support_count, n_baskets, antecedents, __ant, consequents`` of all confident splits.

    Consequents grow item by item. Confidence only falls as they grow, so only those that were confident
    are extended, and an itemset is never expanded into all its splits.
    """
    keyed = cut_lineage(itemsets.select(
        *group, F.col("items").alias("antecedents"), F.col("support_count").alias("__ant")
    ))
    found: list[DataFrame] = []
    sides = (
        itemsets.filter((F.size("items") >= 2) & ~is_hardware_only(F.col("items")))
        .withColumn("consequents", F.explode(F.transform("items", lambda i: F.array(i))))
    )
    while True:
        split = sides.withColumn("antecedents", F.array_except("items", "consequents"))
        confident = cut_lineage(
            split.join(keyed, [*group, "antecedents"])
            .filter(F.col("support_count") / F.col("__ant") >= F.lit(float(min_confidence)))
            .select(*itemsets.columns, "antecedents", "__ant", "consequents")
        )
        found.append(confident)
        longer = confident.filter(F.size("antecedents") >= 2)
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, found)
        # items are sorted, so every consequent is reached once, from its own beginning
        sides = longer.drop("antecedents", "__ant").withColumn(
            "__next", F.explode(F.filter("items", lambda i: i > F.element_at("consequents", -1)))
        ).withColumn("consequents", F.concat("consequents", F.array("__next"))).drop("__next").filter(
            F.size("consequents") < F.size("items")
        )


def with_metrics(sided: DataFrame, group: Sequence[str]) -> DataFrame:
    """Splits with their counts (``__ant``, ``__cons``) as rules with their metrics."""
    n, confidence = F.col("n_baskets"), F.col("support_count") / F.col("__ant")
    ant, cons, both = F.col("__ant"), F.col("__cons"), F.col("support_count")
    ant_share, cons_share = ant / n, cons / n
    return sided.select(
        *group, "items", "antecedents", "consequents",
        ant_share.alias("antecedent_support"),
        cons_share.alias("consequent_support"),
        (both / n).alias("support"),
        confidence.alias("confidence"),
        ((both.cast("double") * n) / (ant.cast("double") * cons)).alias("lift"),
        (both / n - ant_share * cons_share).alias("leverage"),
        F.when(both == ant, F.lit(float("inf")))
        .otherwise((F.lit(1.0) - cons_share) / F.nullif(F.lit(1.0) - confidence, F.lit(0.0)))
        .alias("conviction"),
    )


def association_rules(
    itemsets: DataFrame, group: Sequence[str], min_confidence: float, min_lift: float | None
) -> DataFrame:
    """Every confident split of every frequent itemset into antecedents and consequents, with its metrics.

    Ratios are taken from the counts, so two rules with equal lift compare as equal. Hardware-only
    itemsets are left out before they are split: all their rules would be hardware-only.
    """
    group = list(group)
    sided = _confident_splits(itemsets, group, min_confidence).join(
        itemsets.select(*group, F.col("items").alias("consequents"), F.col("support_count").alias("__cons")),
        [*group, "consequents"],
    )
    rules = with_metrics(sided, group)
    return rules.filter(F.col("lift") >= F.lit(float(min_lift))) if min_lift else rules


def _set_key(items: str) -> Column:
    """64 bits of a set of items: the exclusive or of its items' hashes, so the key of a part follows from its items."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda key, i: key.bitwiseXOR(F.xxhash64(i)))


def _dealt(rows: DataFrame, lookup: DataFrame, group: list[str], by: list[str], chunk_rows: int):
    """(grouped rows, grouped look-up): the rows of a group in chunks, the look-up of the group beside each of them.

    A look-up row is two numbers per frequent itemset of the group, fewer than the task held that named them.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("__chunks"))
    own = attach_by_group(rows, sizes, group, by).withColumn("__chunk", F.pmod(F.xxhash64(*by), "__chunks").cast("int"))
    fresh = [F.col(c).alias(c) for c in lookup.columns]  # the two sides come from one table
    beside = attach_by_group(lookup, sizes, group, ["__key"]).select(
        *fresh, "__chunks", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))
    # few rows, much work: chunks are spread over all partitions instead of packed by size
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tuple(
        x.drop("__chunks").repartition(partitions, *group, "__chunk").groupBy(*group, "__chunk") for x in (own, beside))


class _Lookup:
    """Values by 64-bit key, as sorted arrays."""

    def __init__(self, keys: pd.Series, values: pd.Series):
        order = np.argsort(keys.to_numpy(), kind="stable")
        self.keys, self.values = keys.to_numpy()[order], values.to_numpy()[order]
        if len(order) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two sets of a group share their 64-bit key")

    def __call__(self, keys: np.ndarray, absent) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], absent)


def _slices(lists: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) for lists of equal length, few enough rows that all their parts fit in memory."""
    lengths = lists.map(len).to_numpy()
    for k in np.unique(lengths):
        rows = np.flatnonzero(lengths == k)
        step = max(1, SPLIT_CELLS >> int(k))
        for first in range(0, len(rows), step):
            yield int(k), rows[first : first + step]


def _side_order(sides: np.ndarray, k: int) -> list[np.ndarray]:
    """Numbers that order sides (bits of positions in a sorted itemset) as their arrays of items are ordered."""
    out = []
    for first in range(0, k, 30):
        number = np.zeros(len(sides), dtype=np.int64)
        for i in range(first, min(first + 30, k)):
            later = sides >> i
            number = 3 * number + np.where(later == 0, 0, np.where(later & 1, 1, 2))
        out.append(number)
    return out


def _best_sides(
    hashes: np.ndarray, both: np.ndarray, n: np.ndarray, counts: _Lookup, min_confidence: float, min_lift: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bits of the antecedents, their count, count of the consequents) of the best split of each row that has one.

    Consequents grow item by item, for all rows at once. Confidence only falls as they grow, so only confident ones do.
    """
    m, k = hashes.shape
    whole, everything = np.bitwise_xor.reduce(hashes, axis=1), (1 << k) - 1
    row = np.tile(np.arange(m), k)
    mask, key = np.repeat(np.int64(1) << np.arange(k, dtype=np.int64), m), hashes.T.ravel()
    last, found = np.repeat(np.arange(k), m), []
    for size in range(1, k):
        ant = counts(whole[row] ^ key, 0)
        kept = np.flatnonzero(both[row] / ant >= min_confidence)
        row, mask, key, last, ant = row[kept], mask[kept], key[kept], last[kept], ant[kept]
        if not len(row):
            break
        found.append((row, everything ^ mask, ant, counts(key, 0)))
        if size + 1 < k:
            longer = [(i, np.flatnonzero(last < i)) for i in range(1, k)]
            row, mask, key, last = (np.concatenate(x) for x in zip(*(
                (row[at], mask[at] | (1 << i), key[at] ^ hashes[row[at], i], np.full(len(at), i)) for i, at in longer), strict=True))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 4
    row, sides, ant, cons = (np.concatenate(x) for x in zip(*found, strict=True))
    lift = (both[row].astype(float) * n[row]) / (ant.astype(float) * cons)
    kept = np.flatnonzero(lift >= min_lift)
    row, sides, ant, cons, lift = row[kept], sides[kept], ant[kept], cons[kept], lift[kept]
    order = np.lexsort((*_side_order(sides, k)[::-1], -(both[row] / ant), -lift, row))
    order = order[np.append(True, np.diff(row[order]) != 0)] if len(order) else order
    return row[order], sides[order], ant[order], cons[order]


def best_splits(
    itemsets: DataFrame, group: Sequence[str], min_confidence: float, min_lift: float | None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Of each frequent itemset the split that ``prune_permutations`` would choose from ``association_rules``.

    Splits are made and compared inside tasks and never become rows; an itemset may have up to 62 items.
    """
    group = list(group)
    fields = {f.name: f.dataType.simpleString() for f in itemsets.schema}
    out = [*group, "items", "support_count", "n_baskets", "antecedents", "__ant", "consequents", "__cons"]
    rows = itemsets.filter((F.size("items") >= 2) & ~is_hardware_only(F.col("items"))).select(
        *group, "items", "support_count", "n_baskets", F.transform("items", lambda i: F.xxhash64(i)).alias("__hashes"))
    lookup = itemsets.select(*group, _set_key("items").alias("__key"), "support_count")
    own, beside = _dealt(rows, lookup, group, ["items"], chunk_rows)

    def split(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        parts = []
        counts = _Lookup(table["__key"], table["support_count"])
        for k, at in _slices(rows["items"]):
            some = rows.iloc[at]
            row, sides, ant, cons = _best_sides(
                np.stack(some["__hashes"].to_numpy()).astype(np.int64), some["support_count"].to_numpy(),
                some["n_baskets"].to_numpy(), counts, min_confidence, min_lift or 0.0)
            held = (sides[:, None] >> np.arange(k)) & 1 == 1
            best = some.iloc[row].assign(__ant=ant, __cons=cons)
            names = [np.asarray(items, dtype=object) for items in best["items"]]
            best["antecedents"] = pd.Series([x[h] for x, h in zip(names, held, strict=True)], index=best.index, dtype=object)
            best["consequents"] = pd.Series([x[~h] for x, h in zip(names, held, strict=True)], index=best.index, dtype=object)
            parts.append(best[out])
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=out)

    side = "array<string>"
    ddl = ", ".join([*(f"`{g}` {fields[g]}" for g in group), f"items {side}", "support_count long", "n_baskets long",
                     f"antecedents {side}", "__ant long", f"consequents {side}", "__cons long"])
    return with_metrics(own.cogroup(beside).applyInPandas(split, ddl), group)


def _best_rule(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rule of highest lift per key; ties go to confidence, support, then the sides' order.

    A minimum over a struct, so partial results are formed before the shuffle.
    """
    rest = [c for c in rules.columns if c not in keys]
    order = ["lift", "confidence", "support"]
    ranked = F.struct(
        *[(-F.col(c)).alias(f"o_{c}") for c in order],
        F.col("antecedents").alias("o_ant"), F.col("consequents").alias("o_cons"),
        *[F.col(c) for c in rest],
    )
    best = rules.groupBy(*keys).agg(F.min(ranked).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*rules.columns)


def without_tautologies(rules: DataFrame) -> DataFrame:
    return rules.filter(F.sort_array("antecedents") != F.sort_array("consequents"))


def without_hardware_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(~(is_hardware_only(F.col("antecedents")) & is_hardware_only(F.col("consequents"))))


def prune_permutations(rules: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of all splits of one item pool, the one with the highest lift."""
    return _best_rule(rules, [*group, "items"])


def dedupe_antecedents(rules: DataFrame, group: Sequence[str]) -> DataFrame:
    return _best_rule(rules, [*group, "antecedents"])


def prune_redundant(
    rules: DataFrame, group: Sequence[str], min_improvement: float = MIN_IMPROVEMENT, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Drops a rule whose confidence gains too little over one with fewer antecedents.

    A rule looks up the parts of its own antecedents among the rules of its consequents, by 64-bit keys, instead of
    meeting those rules. Dropped rules still serve as a base for others.
    """
    group = list(group)
    fields = {f.name: f.dataType.simpleString() for f in rules.schema}
    key, side = [*group, "antecedents", "consequents"], F.xxhash64(F.lit("consequents"), F.sort_array("consequents"))
    rows = rules.select(*key, "confidence", F.transform("antecedents", lambda i: F.xxhash64(i)).alias("__hashes"), side.alias("__side"))
    lookup = rules.groupBy(*group, _set_key("antecedents").bitwiseXOR(side).alias("__key")).agg(F.max("confidence").alias("confidence"))
    own, beside = _dealt(rows.filter(F.size("antecedents") >= 2), lookup, group, ["antecedents", "consequents"], chunk_rows)

    def find(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        parts = []
        confidences = _Lookup(table["__key"], table["confidence"])
        for k, at in _slices(rows["antecedents"]):
            some = rows.iloc[at]
            hashes = np.stack(some["__hashes"].to_numpy()).astype(np.int64)
            keys, best = some["__side"].to_numpy()[:, None], np.full(len(some), -np.inf)
            for i in range(k):
                keys = np.concatenate([keys, keys ^ hashes[:, i : i + 1]], axis=1)
            for part in range(1, keys.shape[1] - 1):
                best = np.maximum(best, confidences(keys[:, part], -np.inf))
            parts.append(some.loc[some["confidence"].to_numpy() - best < min_improvement, key])
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=key)

    ddl = ", ".join(f"`{c}` {fields[c]}" for c in key)
    return rules.join(own.cogroup(beside).applyInPandas(find, ddl), key, "left_anti")


def prune_rules(rules: DataFrame, group: Sequence[str], deduplicate_mode: str = "both") -> DataFrame:
    """The filters and deduplication after rule generation, in their order."""
    rules = without_hardware_rules(without_tautologies(rules))
    if deduplicate_mode in ("itemset", "both"):
        rules = prune_permutations(rules, group)
    if deduplicate_mode in ("antecedent", "both"):
        rules = dedupe_antecedents(rules, group)
    return prune_redundant(cut_lineage(rules), group)


def mine(
    baskets: DataFrame,
    group: Sequence[str],
    min_support: float = 0.02,
    min_confidence: float = 0.5,
    min_lift: float | None = 1.2,
    deduplicate_mode: str = "both",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The full mining pass per group, highest lift first; both sides come out as ``"a AND b"`` text."""
    itemsets = cut_lineage(frequent_itemsets(baskets, group, min_support, block_rows))
    if deduplicate_mode in ("itemset", "both"):
        rules = best_splits(itemsets, group, min_confidence, min_lift)
    else:
        rules = association_rules(itemsets, group, min_confidence, min_lift)
    return by_lift(rules_as_text(prune_rules(rules, group, deduplicate_mode), group))


def rules_as_text(rules: DataFrame, group: Sequence[str]) -> DataFrame:
    return rules.select(
        *group,
        itemset_text(F.col("antecedents")).alias("antecedents"),
        itemset_text(F.col("consequents")).alias("consequents"),
        *RULE_METRICS,
    )


def by_lift(rules: DataFrame) -> DataFrame:
    """Highest lift first; equal lifts in the order of the deduplication tie-break."""
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequents")
