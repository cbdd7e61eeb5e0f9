"""Tags, itemsets and rules as English text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.itemsets import split_items

# Readable names of the score pillars.
PILLAR_LABELS = {
    "gameplay": "gameplay",
    "community": "community",
    "immersion": "immersion",
    "story": "story",
    "audio": "audio",
    "graphics": "graphics",
    "controls": "controls",
    "difficulty": "difficulty",
    "customization": "customization",
    "replayability": "replayability",
    "monetizationModel": "monetization model",
    "multiplayer": "multiplayer",
}

# Phrases of the boolean tags.
BOOLEAN_PHRASES = {
    "voted_up_True": "left a positive review",
    "voted_up_False": "left a negative review",
    "actuallyRecommendsTitle_True": "recommended the game",
    "actuallyRecommendsTitle_False": "did not recommend the game",
    "containsPositiveAspects_True": "highlighted positive aspects",
    "containsPositiveAspects_False": "did not highlight any positive aspects",
    "containsNegativeAspects_True": "highlighted negative aspects",
    "containsNegativeAspects_False": "did not highlight any negative aspects",
    "containsBugDescription_True": "reported bugs in their review",
    "containsBugDescription_False": "did not report any bugs",
    "isUseful_True": "wrote a review others found helpful",
    "isUseful_False": "wrote a review others did not find helpful",
    "steam_purchase_True": "purchased the game on Steam",
    "steam_purchase_False": "had not purchased the game on Steam",
    "received_for_free_True": "received the game for free",
    "received_for_free_False": "did not receive the game for free",
    "primarily_steam_deck_True": "primarily played on Steam Deck",
    "primarily_steam_deck_False": "did not primarily play on Steam Deck",
}

# Phrases of the playtime buckets.
PLAYTIME_PHRASES = {
    "refund_zone": "played under 2 hours",
    "casual": "played under 10 hours",
    "mid_core": "played between 10 and 50 hours",
    "heavy": "played over 50 hours",
    "hardcore": "played over 200 hours",
}

# Phrases of the daily trends.
TREND_PHRASES = {
    "retention_growth": "joined during a period of rising player numbers",
    "retention_drop": "joined during a period of falling player numbers",
    "retention_stable": "joined during a period of stable player numbers",
}

# Language names.
LANGUAGE_NAMES = {
    "english": "English",
    "schinese": "Simplified Chinese",
    "tchinese": "Traditional Chinese",
    "russian": "Russian",
    "turkish": "Turkish",
    "french": "French",
    "german": "German",
    "spanish": "Spanish",
    "brazilian": "Brazilian Portuguese",
    "italian": "Italian",
    "japanese": "Japanese",
    "korean": "Korean",
    "polish": "Polish",
    "portuguese": "Portuguese",
    "dutch": "Dutch",
    "swedish": "Swedish",
    "norwegian": "Norwegian",
    "danish": "Danish",
    "finnish": "Finnish",
    "czech": "Czech",
    "hungarian": "Hungarian",
    "romanian": "Romanian",
    "ukrainian": "Ukrainian",
    "greek": "Greek",
    "hebrew": "Hebrew",
    "arabic": "Arabic",
    "thai": "Thai",
    "vietnamese": "Vietnamese",
    "indonesian": "Indonesian",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    literal_map = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal_map, key)


def spaced(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def title_case(text: Column) -> Column:
    """A capital after every character that is no letter, small letters elsewhere."""
    pieces = F.split(F.lower(text), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def language_name(code: Column) -> Column:
    code = F.coalesce(code, F.lit(""))
    return F.coalesce(_lookup(LANGUAGE_NAMES, F.lower(code)), title_case(code))


def tag_phrase(tag: Column) -> Column:
    """One tag as a past-tense predicate; unknown tags stay legible."""
    t = F.trim(tag)
    low = F.lower(t)

    def after(text: Column, prefix: str) -> Column:
        return F.substring(text, F.lit(len(prefix) + 1), F.length(text))

    playtime = after(low, "playtime_")
    code = after(t, "lang_")
    trend = after(low, "kpi_")
    pillar = F.regexp_extract(t, rf"^({'|'.join(PILLAR_LABELS)})_(\d+)$", 1)
    rating = F.regexp_extract(t, r"_(\d+)$", 1)
    return (
        F.when(
            low.startswith("playtime_"),
            F.coalesce(_lookup(PLAYTIME_PHRASES, playtime), F.concat(F.lit("played "), spaced(playtime))),
        )
        .when(
            low.startswith("lang_"),
            F.concat(
                F.lit("wrote in "),
                F.coalesce(_lookup(LANGUAGE_NAMES, F.lower(code)), title_case(spaced(code))),
            ),
        )
        .when(low.startswith("kpi_"), F.coalesce(_lookup(TREND_PHRASES, trend), spaced(trend)))
        .when(low.startswith("hw_ram_"), F.concat(F.lit("had "), spaced(after(t, "hw_ram_")), F.lit(" of RAM")))
        .when(low.startswith("hw_vram_"), F.concat(F.lit("had "), spaced(after(t, "hw_vram_")), F.lit(" of VRAM")))
        .when(low.startswith("hw_os_"), F.concat(F.lit("played on "), spaced(after(t, "hw_os_"))))
        .when(low.startswith("hw_"), F.concat(F.lit("used "), spaced(after(t, "hw_"))))
        .otherwise(
            F.coalesce(
                _lookup(BOOLEAN_PHRASES, t),
                F.when(
                    pillar != "",
                    F.concat(F.lit("rated the "), _lookup(PILLAR_LABELS, pillar), F.lit(" "), rating, F.lit("/5")),
                ),
                spaced(t),
            )
        )
    )


def item_phrases(text: Column) -> Column:
    """The phrases of a stored itemset, as an array."""
    return F.filter(F.transform(split_items(text), tag_phrase), lambda p: p != "")


def join_phrases(phrases: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(phrases)
    head = F.array_join(F.slice(phrases, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, phrases[0]).otherwise(
        F.concat(head, F.lit(" and "), F.try_element_at(phrases, F.lit(-1)))
    )


def sentence(left: Column, right: Column) -> Column:
    """The rule with the phrases of both sides; without a right side just the group."""
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit("All Reviews"))
        .when(F.size(right) == 0, F.concat(F.lit("Reviewers who "), join_phrases(left)))
        .otherwise(
            F.concat(F.lit("When reviewers "), join_phrases(left), F.lit(", they also "), join_phrases(right), F.lit("."))
        )
    )


def with_sentence(rules: DataFrame, name: str = "text") -> DataFrame:
    """Adds the sentence of ``antecedents`` and ``consequents``; phrases are computed once per side."""
    return (
        rules.withColumn("__left", item_phrases(F.col("antecedents")))
        .withColumn("__right", item_phrases(F.col("consequents")))
        .withColumn(name, sentence(F.col("__left"), F.col("__right")))
        .drop("__left", "__right")
    )


def severity(lift: Column) -> Column:
    return (
        F.when(lift >= 1.5, F.lit("critical"))
        .when(lift >= 1.2, F.lit("warning"))
        .when(lift >= 1.0, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )
