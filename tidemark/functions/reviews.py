"""Columns of one review: cleaning, labels, tags and display values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import BASKET_HARDWARE, BOOLEANS, PILLARS

# Upper bounds of the playtime buckets, in minutes.
PLAYTIME_BUCKETS = [("refund_zone", 120), ("casual", 600), ("mid_core", 3000), ("heavy", 12000)]
PLAYTIME_TOP = "hardcore"
NO_HARDWARE = "N/A"
UNKNOWN = "Unknown"


def gigabytes(megabytes: Column) -> Column:
    """``"<n>GB"``, halves to even; ``Unknown`` when missing, not a number or not positive."""
    mb = megabytes.try_cast("int")
    return F.when(mb > 0, F.concat(F.bround(mb / F.lit(1024)).cast("int").cast("string"), F.lit("GB"))).otherwise(
        F.lit(UNKNOWN)
    )


def resolution(width: Column, height: Column) -> Column:
    known = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    return F.when(known, F.concat_ws("x", width.cast("string"), height.cast("string"))).otherwise(F.lit(UNKNOWN))


def review_columns(r: Column, as_of: Column) -> list[Column]:
    """The stored columns of one raw review struct ``r``, with typed defaults.

    ``timestamp_created`` is carried along because the day of a review is the day it was
    written, while the stored time is that of its last update.
    """
    hw = r["hardware"]
    has_hw = F.coalesce(
        hw.isNotNull()
        & F.greatest(*[hw[c].isNotNull() for c in (
            "os", "dx_video_card", "cpu_vendor", "system_ram", "vram_size", "screen_width", "screen_height")]),
        F.lit(False),
    )

    def hardware(value: Column) -> Column:
        return F.when(has_hw, value).otherwise(F.lit(NO_HARDWARE))

    def text(name: str) -> Column:
        return F.coalesce(r[name], F.lit(""))

    def flag(name: str) -> Column:
        return F.coalesce(r[name], F.lit(False))

    return [
        text("recommendationid").alias("recommendationid"),
        text("review").alias("review"),
        text("language").alias("language"),
        F.coalesce(r["timestamp_created"], F.lit(0).cast("long")).alias("timestamp_created"),
        F.coalesce(r["timestamp_updated"], as_of).cast("int").alias("timestamp_updated"),
        flag("steam_purchase").alias("steam_purchase"),
        flag("received_for_free").alias("received_for_free"),
        flag("voted_up").alias("voted_up"),
        F.coalesce(r["weighted_vote_score"].try_cast("double"), F.lit(0.0)).alias("weighted_vote_score"),
        F.coalesce(r["author"]["playtime_at_review"].try_cast("int"), F.lit(0)).alias("playtime_at_review"),
        flag("primarily_steam_deck").alias("primarily_steam_deck"),
        has_hw.alias("has_hardware_info"),
        hardware(resolution(hw["screen_width"], hw["screen_height"])).alias("hw_resolution"),
        hardware(gigabytes(F.coalesce(hw["system_ram"], F.lit("0")))).alias("hw_ram"),
        hardware(gigabytes(F.coalesce(hw["vram_size"], F.lit("0")))).alias("hw_vram"),
        hardware(F.coalesce(hw["dx_video_card"], F.lit(UNKNOWN))).alias("hw_gpu"),
        hardware(F.coalesce(hw["os"], F.lit(UNKNOWN))).alias("hw_os"),
        hardware(F.coalesce(hw["cpu_vendor"], F.lit(UNKNOWN))).alias("hw_cpu_vendor"),
    ]


def round_binary(x: Column, digits: int) -> Column:
    """Rounds a non-negative double by its exact binary value, exact ties to even.

    ``bround`` rounds the printed decimal, so it takes 0.05 for a tie although the double lies
    above it. The fraction is exact in 62 bits, and its scaled value is exact as a decimal.
    """
    unit, scale = Decimal(2**62), 10**digits
    whole = F.floor(x)
    part = ((x - whole) * F.lit(2.0**62)).cast("long").cast("decimal(38,0)") * F.lit(Decimal(scale))
    rest = part % F.lit(unit)
    steps = ((part - rest) / F.lit(unit)).cast("long")
    up = (rest > F.lit(unit / 2)) | ((rest == F.lit(unit / 2)) & (steps % 2 == 1))
    return (whole * scale + steps + F.when(up, F.lit(1)).otherwise(F.lit(0))) / F.lit(float(scale))


def utc_day(epoch_seconds: Column) -> Column:
    """The day of an epoch second; the session zone is UTC (see ``session.use_utc``)."""
    return F.to_date(F.timestamp_seconds(epoch_seconds))


def playtime_bucket(minutes: Column) -> Column:
    label = F.when(minutes.isNull(), F.lit(None))
    for name, below in PLAYTIME_BUCKETS:
        label = label.when(minutes < below, F.lit(f"playtime_{name}"))
    return label.otherwise(F.lit(f"playtime_{PLAYTIME_TOP}"))


def basket(trend: Column) -> Column:
    """The sorted, distinct tags of one review row; ``trend`` is its day's KPI trend or null."""
    tags = [F.concat(F.lit(f"{p}_"), F.col(p).cast("string")) for p in PILLARS]
    tags += [F.when(F.col(b), F.lit(f"{b}_True")).when(~F.col(b), F.lit(f"{b}_False")) for b in BOOLEANS]
    tags.append(playtime_bucket(F.col("playtime_at_review")))
    tags.append(F.when(F.col("language") != "", F.concat(F.lit("lang_"), F.col("language"))))
    for h in BASKET_HARDWARE:
        present = F.col("has_hardware_info") & ~F.col(h).isin(NO_HARDWARE, UNKNOWN)
        tags.append(F.when(present, F.concat(F.lit(f"{h}_"), F.replace(F.col(h), F.lit(" "), F.lit("_")))))
    tags.append(F.when(trend != "", F.concat(F.lit("kpi_"), trend)))
    # array_except drops the nulls and repeats without leaving generated code.
    return F.sort_array(F.array_except(F.array(*tags), F.array(F.lit(None).cast("string"))))
