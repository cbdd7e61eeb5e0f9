"""Mixing sources to target weights, in DataFrame functions only.

1. The words of a source's documents stand one after another in a fixed order; the row is packed into blocks of
   ``block_words``, the last one shorter. Running totals are made in two levels, so no task holds a whole source.
2. Every source has a target: its weight's share of ``share`` times all words, at most ``most`` times its own; what is
   above goes to the others by weight. A target is a number of blocks, the source's quota.
3. Output shards have ``shard_slots`` slots. A slot draws its source from a table of tickets that are dealt in proportion
   to the quotas, so the source counts of a shard are multinomial. Slots that a source draws beyond its quota go, in
   order, to sources that drew less, so every quota is met exactly.
4. The slots of a source are numbered over all shards. Slot number k takes block π(k mod blocks), where π is a
   pseudorandom permutation of the source's block numbers (swap-or-not, a new one for each time round), so a block is
   taken at most ``most`` times. Slots and packed documents meet in a join on source and block.

All draws are hashes of the seed and positions: reruns agree, whatever the partitions. The table of sources (a row each)
is ordered in one task; no row of it reaches the driver.

Defined results: a null text has size 0, as has one without words; it takes part in no block and is taken 0 times. A null
source is a source of its own, the last. Repeated rows are documents each. Without any word all targets are 0. An empty
table gives no rows. Only the columns named are read, others cannot clash; the id column keeps its name and type.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text, written
from tidemark.skew import attach_by_group

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, TICKETS, ROUNDS, SEED = 128, 1024, 1 << 16, 24, 13
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts) -> Column:
    return F.xxhash64(*[p.cast("long") if isinstance(p, Column) else F.lit(p).cast("long") for p in parts])


def running_totals(rows: DataFrame, group: Sequence[str], cell: str, order: Sequence, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before in the group; by cell, then by ``order`` inside it.

    A group has as many rows in one task as it has cells, and a cell as many as it has rows.
    """
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = rows.groupBy(*group, cell).agg(F.sum(value).alias("__sum")).select(
        *group, cell, F.coalesce(F.sum("__sum").over(before), zero).alias("__start"))
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("__within", F.coalesce(F.sum(value).over(inside), zero))
    return within.join(cells, [*group, cell]).withColumn(name, F.col("__start") + F.col("__within")).drop("__start", "__within")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (``key, source, source_size``) with ``sid`` in code point order, null last, and ``target``.

    A source is held at ``most`` times its size if that is below its weight times the level that the rest is filled to.
    Sources in the order of size by weight reach that limit one after another; the level is that of the first row which
    is not held when all before it are.
    """
    one, code_points = F.lit(1), Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("sid", F.row_number().over(code_points) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)))
    by_ratio = Window.orderBy("ratio", "sid")
    whole = Window.partitionBy(one)
    filled = ranked.withColumn("ratio", most * F.col("source_size") / F.col("weight")).withColumns({
        "held": F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "wanted": F.lit(float(share)) * F.sum("source_size").over(whole),
    }).withColumn("level", (F.col("wanted") - F.col("held")) / F.col("rest"))
    # levels only fall behind the first such row
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    reached = filled.withColumn("filled", F.coalesce(level, F.max("ratio").over(whole)))
    return reached.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("filled"))).select(
        "key", "source", "sid", "source_size", "target")


def with_quotas(targets: DataFrame, block_words: int, most: int) -> DataFrame:
    """Adds ``n_blocks`` and ``quota``, the blocks that the mix takes of the source, and ``first_quota`` before it."""
    n_blocks = F.ceil(F.col("source_size") / block_words)
    wanted = F.round(F.col("target") * n_blocks / F.nullif(F.col("source_size"), F.lit(0))).cast("long")
    rows = targets.withColumn("n_blocks", n_blocks).withColumn(
        "quota", F.coalesce(F.least(most * F.col("n_blocks"), wanted), F.lit(0)))
    return rows.withColumn("first_quota", F.sum("quota").over(Window.orderBy("sid")) - F.col("quota"))


def permuted(index: Column, n: Column, keys: Sequence[Column], rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """Where a pseudorandom permutation of 0..n-1 puts ``index`` (swap-or-not: each round pairs x with K - x)."""
    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(_hash(seed, r, *keys) - x, n)
        return F.when(_hash(seed + 1, r, *keys, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), turn)


def draw_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, tickets: int = TICKETS, seed: int = SEED) -> DataFrame:
    """``shard, sid, k, block`` of every slot of the mix; ``sources`` is a written table with quotas."""
    spark = sources.sparkSession
    n_slots = sources.agg(F.sum("quota")).first()[0] or 0
    share = F.lit(tickets) / max(1, n_slots)
    dealt = sources.select("sid", F.floor(F.col("first_quota") * share).alias("low"),
                           F.floor((F.col("first_quota") + F.col("quota")) * share).alias("high")).filter("low < high")
    dealt = dealt.select("sid", F.explode(F.expr("sequence(low, high - 1)")).alias("ticket"))
    drawn = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(_hash(seed, F.col("id")), F.lit(tickets)).alias("ticket"))
    # the multinomial source counts of every shard
    counts = written(drawn.join(dealt, "ticket").groupBy("shard", "sid").agg(F.count("*").alias("n")), "shard-counts")
    shards_a_cell = max(1, math.isqrt(-(-n_slots // shard_slots)))
    numbered = running_totals(
        counts.withColumn("cell", F.floor(F.col("shard") / shards_a_cell)), ["sid"], "cell", ["shard"], "n", "first")

    totals = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    order = Window.orderBy("sid")
    quotas = sources.select("sid", "n_blocks", "quota").join(totals, "sid", "left").fillna(0, ["drawn"]).withColumns({
        "over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "under": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)),
    }).withColumns({
        "first_over": F.sum("over").over(order) - F.col("over"), "first_under": F.sum("under").over(order) - F.col("under")})
    quotas = written(quotas, "source-quotas")
    slots = attach_by_group(numbered, quotas.select("sid", "quota", "first_over"), ["sid"], ["shard"]).select(
        "shard", "sid", "quota", "first_over", F.explode(F.expr("sequence(first, first + n - 1)")).alias("k"))
    lacking = quotas.filter("under > 0").select(
        "sid", F.explode(F.expr("sequence(drawn, quota - 1)")).alias("k"), (F.col("first_under") - F.col("drawn")).alias("shift"))
    moved = slots.filter("k >= quota").select("shard", (F.col("first_over") + F.col("k") - F.col("quota")).alias("turn")).join(
        lacking.select("sid", "k", (F.col("shift") + F.col("k")).alias("turn")), "turn")
    kept = slots.filter("k < quota").select("shard", "sid", "k").unionByName(moved.select("shard", "sid", "k"))
    sized = attach_by_group(kept, quotas.select("sid", "n_blocks"), ["sid"], ["k"])
    n = F.col("n_blocks")
    return sized.select("shard", "sid", "k", permuted(
        F.col("k") % n, n, [F.col("sid"), F.floor(F.col("k") / n)], seed=seed).alias("block"))


def pack(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[int], share: float, most: int,
         block_words: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: documents with their size and ``start`` in their source's row, and the sources with quotas."""
    source = F.col(source_col)
    rows = written(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("key"), source.alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_col).alias("tie")), "mix-sizes")
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = written(with_quotas(source_targets(sizes, weights, share, most), block_words, most), "mix-sources")
    n_cells = max(1, math.isqrt(rows.count()))
    known = attach_by_group(rows.drop("source"), sources.select("key", "sid", "source_size", "target"), ["key"], ["id", "tie"])
    celled = known.withColumn("cell", F.pmod(F.xxhash64("id", "tie"), F.lit(n_cells)))
    order = [F.asc_nulls_first("id"), "tie"]
    return written(running_totals(celled, ["sid"], "cell", order, "size", "start").drop("cell", "key"), "mix-documents"), sources


def pieces_of(rows: DataFrame, block_words: int) -> DataFrame:
    """The parts of documents in blocks: ``block``, ``at`` (first word of the part in the document) and ``n`` words."""
    b = F.col("block") * block_words
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.expr(
        f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    return cut.withColumn("at", F.greatest(b - F.col("start"), F.lit(0))).withColumn(
        "n", F.least(b + block_words - F.col("start"), F.col("size")) - F.col("at"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, seed: int = SEED,
) -> DataFrame:
    """Per document: its id, ``size``, ``source_size``, ``target`` of its source and ``taken``, the words the mix takes."""
    rows, sources = pack(docs, id_col, source_col, text_col, weights, share, most, block_words)
    times = draw_slots(sources, shard_slots, seed=seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    own = ["id", "size", "source_size", "target"]
    met = pieces_of(rows, block_words).join(times, ["sid", "block"], "left")
    # a document with words is the only one that starts where it does
    taken = met.groupBy("sid", "start", *own).agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = rows.filter("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return taken.select(*own, "taken").unionByName(none).withColumnRenamed("id", id_col)


def mixed_blocks(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, seed: int = SEED,
) -> DataFrame:
    """The mix itself: ``shard, sid, k, block, words``; a row per slot with the words of its block."""
    rows, sources = pack(docs, id_col, source_col, text_col, weights, share, most, block_words)
    slots = draw_slots(sources, shard_slots, seed=seed)
    # the text comes back by what the packing was made from; equal rows have equal words
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.xxhash64(text_col).alias("tie"),
        F.regexp_extract_all(whole_text(text_col), F.lit(WORD), F.lit(0)).alias("words")).dropDuplicates(["name", "tie"])
    named = pieces_of(rows, block_words).withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit("")))
    parts = named.join(texts, ["name", "tie"]).select(
        "sid", "block", "start", F.slice("words", (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("words"))
    # no more parts than words in a block
    blocks = parts.groupBy("sid", "block").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "words"))), lambda x: x["words"])).alias("words"))
    return slots.join(blocks, ["sid", "block"]).select("shard", "sid", "k", "block", "words")
