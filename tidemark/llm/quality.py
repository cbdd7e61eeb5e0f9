"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs of a text are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted: one from the trusted target, ``TRUSTED_ROWS`` labelled texts at most, one from all texts of the corpus. A text's score is the mean
log-ratio of its n-grams, so long and short texts compare. The threshold is a quantile of the scores of all trusted
texts, so the share of them that it loses is stated; every text is held against it. The model is one array of ``buckets`` numbers whatever
the corpus, so it travels with the plan as a literal; texts are scored where they lie, without a shuffle, and written
with their counts and score.

Defined results: a null text has no words, fails the base rules and is rejected. Repeated rows are judged each.
Without trusted texts the base rules alone decide. A label row for an unknown document, or with nulls, is no
target. Columns named like a result are replaced, all others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, written, whole_text

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 13
#: Share of trusted texts that may be lost below the threshold, and nats an n-gram that it is lowered by. Good and bad
#: texts lie some hundredths of a nat apart, so nothing is taken off.
QUANTILE, MARGIN = 0.001, 0.0
SMOOTHING = 1.0
#: Labelled documents that the target is counted from, at most; the corpus and the threshold take in all.
TRUSTED_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [*COUNTS, "base_failed", "llr", "kept"]
_SPLIT = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, in order."""
    return F.transform(F.filter(F.split(text, _SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _window_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of the runs of n elements, in order; none for shorter arrays.

    Shifted copies are zipped, so no lambda looks into an array from outside and every step is linear.
    """
    size = F.greatest(F.size(hashes) - (n - 1), F.lit(0))
    runs = F.slice(hashes, F.lit(1), size)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(hashes, F.lit(1 + k), size), lambda a, b: F.xxhash64(a, b))
    return runs


def with_repeats(rows: DataFrame, hashes: str = "__hashes") -> DataFrame:
    """``n_repeat_words``: words inside 3-word windows that the text holds twice or more.

    Equal windows are neighbours once the windows are sorted, so no window is compared with all others. The words
    covered are then counted from the gaps between the starts.
    """
    runs = F.transform(_window_hashes(F.col(hashes), 3), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("__runs", F.sort_array(runs))
    n_pairs = F.greatest(F.size("__runs") - 1, F.lit(0))
    equal = F.zip_with(F.slice("__runs", F.lit(1), n_pairs), F.slice("__runs", F.lit(2), n_pairs),
                       lambda a, b: a["h"] == b["h"])
    no = F.array(F.lit(False))
    rows = rows.withColumn("__equal", equal)
    shared = F.zip_with(F.concat(no, "__equal"), F.concat("__equal", no), lambda a, b: a | b)
    starts = F.zip_with("__runs", shared, lambda x, again: F.when(again, x["i"]))
    rows = rows.withColumn("__starts", F.sort_array(F.filter(starts, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "__starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", covered).drop("__runs", "__equal", "__starts")


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line: those lines less their distinct ones."""
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, WHITE) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the base counts, ``base_failed`` and ``__hashes``, the hashes of the words in order."""
    text = whole_text(text_col)
    kept = docs.select(*[c for c in docs.columns if c not in RESULT])
    rows = kept.withColumn("__hashes", word_hashes(text)).withColumns({
        "n_words": F.size("__hashes").cast("long"),
        "word_chars": F.length(_without(text, WHITE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": _dup_lines(text),
    })
    rows = with_repeats(rows)
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


# --- The log-likelihood ratio -------------------------------------------------------------------


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and word pairs of a text."""
    return F.transform(F.concat(hashes, _window_hashes(hashes, 2)), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, trusted (boolean), n``; at most twice as many rows as buckets leave a task."""
    exploded = texts.select("trusted", F.explode(ngram_buckets(word_hashes(whole_text(text_col)), buckets)).alias("bucket"))
    return exploded.groupBy("bucket", "trusted").agg(F.count("*").alias("n"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(p target / p corpus) of every bucket; the corpus includes the target."""
    by_bucket = counts.groupBy("bucket").agg(
        F.sum(F.when(F.col("trusted"), F.col("n")).otherwise(0)).alias("target"), F.sum("n").alias("corpus"))
    totals = by_bucket.agg(F.sum("target").alias("t"), F.sum("corpus").alias("c")).first()
    if not totals["t"]:
        return []
    weight = F.log((F.col("target") + SMOOTHING) / F.lit(totals["t"] + SMOOTHING * buckets)) - F.log(
        (F.col("corpus") + SMOOTHING) / F.lit(totals["c"] + SMOOTHING * buckets))
    unseen = math.log((totals["c"] + SMOOTHING * buckets) / (totals["t"] + SMOOTHING * buckets))
    out = [unseen] * buckets
    for row in by_bucket.select("bucket", weight.alias("w")).collect():  # a row per bucket at most
        out[row["bucket"]] = row["w"]
    return out


def llr(hashes: Column, weights: list[float]) -> Column:
    """Mean log-ratio of a text's n-grams; null for a text without words."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    found = ngram_buckets(hashes, len(weights))
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1))


def distinct_ids(trusted_ids: DataFrame) -> DataFrame:
    """``__trusted_id``: the distinct ids without null."""
    return trusted_ids.select(F.col(trusted_ids.columns[0]).alias("__trusted_id")).na.drop().distinct()


def trusted_sample(trusted_ids: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """``__trusted_id``: at most ``rows`` distinct ids, those of lowest hash."""
    return distinct_ids(trusted_ids).orderBy(F.xxhash64("__trusted_id"), "__trusted_id").limit(rows)


def quality_rules(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = BUCKETS, quantile: float = QUANTILE, margin: float = MARGIN, trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """The documents with the base counts, ``base_failed``, ``llr`` and ``kept``."""
    # a bounded number of ids goes to every task, so texts are read in place and never shuffled
    ids = F.broadcast(written(trusted_sample(trusted_ids, trusted_rows), "trusted-ids"))
    is_trusted = F.col(id_col) == F.col("__trusted_id")
    marked = docs.join(ids, is_trusted, "left").select(
        F.col("__trusted_id").isNotNull().alias("trusted"), F.col(text_col).alias("__text"))
    weights = log_ratios(written(bucket_counts(marked, "__text", buckets), "bucket-counts"), buckets)
    rows = with_counts(docs, text_col)
    if not weights:
        return rows.withColumns({"llr": F.lit(None).cast("double"), "kept": ~F.col("base_failed")}).drop("__hashes")
    # judged once and written: what reads a few columns or filters by them repeats no counting
    rows = written(rows.withColumn("llr", llr(F.col("__hashes"), weights)).drop("__hashes"), "quality-rows")
    # the scores of every trusted document meet all ids, whose number no bound holds; texts stay where they are
    sound = rows.filter(~F.col("base_failed")).select(F.col(id_col).alias("__id"), "llr").join(
        distinct_ids(trusted_ids), F.col("__id") == F.col("__trusted_id"))
    low = sound.agg(F.percentile_approx("llr", quantile, 100_000).alias("low")).first()["low"]
    limit = F.lit(None).cast("double") if low is None else F.lit(low - margin)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= limit, F.lit(True)))
