"""The engine's inputs, taken from the benchmark tables.

``documents`` and ``labels`` stand for reviews, ``orders`` for a long history of player
observations, ``events`` for a month of hourly activity and ``lineitem`` with its dimensions for
a second kind of basket. The expressions below are plain SQL that reads the same in Spark and in
the checking engine; the operators under test are written separately on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.kpis import daily_kpis
from tidemark.session import use_utc

# 2001-08-01 00:00:00 UTC, the end of the order history; stands for "now" in every query.
AS_OF = 996624000
AS_OF_DAY = "2001-08-01"

REVIEW_COLUMNS = {
    "app_id": "CAST(substr(source, 4) AS BIGINT) % 5 + 1",
    "recommendationid": "CAST(doc_id AS STRING)",
    "review": "text",
    "language": "CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' "
                "WHEN 'es' THEN 'spanish' ELSE lang END",
    "timestamp_updated": f"CAST({AS_OF} - 1 - (doc_id * 7919) % 12096000 AS INT)",
    "steam_purchase": "n_chars % 2 = 0",
    "received_for_free": "n_chars > 2000",
    "voted_up": "quality = 1",
    "weighted_vote_score": "CAST(n_chars % 1000 AS DOUBLE) / 1000",
    "playtime_at_review": "CAST(n_chars AS INT)",
    "primarily_steam_deck": "length(replace(text, 'th', '')) = length(text)",
    "has_hardware_info": "doc_id % 3 = 0",
    "hw_resolution": "CASE WHEN doc_id % 3 = 0 THEN '1920x1080' ELSE 'N/A' END",
    "hw_ram": "CASE WHEN doc_id % 3 <> 0 THEN 'N/A' WHEN n_chars % 3 = 0 THEN '8GB' "
              "WHEN n_chars % 3 = 1 THEN '16GB' ELSE 'Unknown' END",
    "hw_vram": "CASE WHEN doc_id % 3 <> 0 THEN 'N/A' WHEN n_chars % 3 = 0 THEN '4GB' ELSE '8GB' END",
    "hw_gpu": "CASE WHEN doc_id % 3 <> 0 THEN 'N/A' ELSE 'Unknown' END",
    "hw_os": "CASE WHEN doc_id % 3 <> 0 THEN 'N/A' WHEN doc_id % 2 = 0 THEN 'Windows 11' ELSE 'Arch Linux' END",
    "hw_cpu_vendor": "CASE WHEN doc_id % 3 <> 0 THEN 'N/A' ELSE 'GenuineIntel' END",
    "isSpam": "coalesce(toxic = 1, FALSE)",
    "multiplayer": "CASE WHEN doc_id % 11 = 0 THEN CAST(1 + n_chars % 5 AS INT) END",
    "immersion": "CASE quality WHEN 1 THEN 4 WHEN 0 THEN 2 END",
    "community": "CASE WHEN toxic = 0 THEN CAST(3 + n_chars % 3 AS INT) END",
    "replayability": "CASE WHEN doc_id % 13 = 0 THEN CAST(1 + n_chars % 5 AS INT) END",
    "story": "CASE WHEN n_chars % 4 = 0 THEN NULL WHEN n_chars < 500 THEN 2 WHEN n_chars < 4000 THEN 3 ELSE 5 END",
    "monetizationModel": "CASE WHEN doc_id % 17 = 0 THEN CAST(1 + n_chars % 5 AS INT) END",
    "gameplay": "CAST(1 + (length(text) - length(replace(text, ' ', ''))) % 5 AS INT)",
    "controls": "CASE WHEN doc_id % 19 = 0 THEN 3 END",
    "graphics": "CASE WHEN length(text) - length(replace(text, chr(10), '')) > 20 THEN 5 "
                "WHEN length(text) <> length(replace(text, chr(10), '')) THEN 3 END",
    "customization": "CASE WHEN doc_id % 23 = 0 THEN 1 END",
    "audio": "CASE WHEN doc_id % 29 = 0 THEN 5 END",
    "difficulty": "CASE WHEN doc_id % 31 = 0 THEN 2 END",
    "isUseful": "quality = 1 AND n_chars > 300",
    "containsPositiveAspects": "text LIKE '%tion%'",
    "containsNegativeAspects": "text LIKE '%@%'",
    "actuallyRecommendsTitle": "CASE WHEN n_chars % 5 > 0 THEN quality = 1 END",
    "containsBugDescription": "CASE WHEN doc_id % 7 = 0 THEN text LIKE '%404%' END",
}

OBSERVATION_COLUMNS = {
    "app_id": "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)",
    "players": "CAST(floor(o_totalprice / 100) AS INT)",
}

# The five event types as apps, in alphabetical order.
EVENT_APP = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
    "WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END"
)


def _aliased(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left").selectExpr(*_aliased(REVIEW_COLUMNS))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app_id, players, added`` with ``added`` as ISO-8601 text."""
    added = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00Z")).alias("added")
    orders = table(spark, sf_dir, "orders")
    return orders.select(*[F.expr(e) for e in _aliased(OBSERVATION_COLUMNS)], added)


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_kpis(observations(spark, sf_dir))


def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per event type and hour, as player observations."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (
        events.groupBy(F.expr(EVENT_APP).cast("long").alias("app_id"), hour.alias("hour"))
        .agg(F.countDistinct("user_id").cast("int").alias("players"))
        .select("app_id", "players", F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added"))
    )


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One basket of tags per order with lines: ``app_id, o_orderkey, items``."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    tags = F.array(
        F.concat(F.lit("type_"), "p_type"),
        F.concat(F.lit("flag_"), "l_returnflag", "l_linestatus"),
        F.concat(F.lit("brand_"), F.replace("p_brand", F.lit("#"), F.lit("_"))),
    )
    per_order = lines.groupBy("l_orderkey").agg(F.collect_list(tags).alias("line_tags"))
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr(OBSERVATION_COLUMNS["app_id"]).alias("app_id"),
        "o_orderkey",
        F.sort_array(F.array_distinct(F.concat(
            F.flatten("line_tags"),
            F.array(F.concat(F.lit("status_"), "o_orderstatus"), F.concat(F.lit("segment_"), "c_mktsegment")),
        ))).alias("items"),
    )


# --- The same inputs as SQL, for the oracles -------------------------------------------------

REVIEWS_SQL = f"SELECT {', '.join(_aliased(REVIEW_COLUMNS))} FROM documents LEFT JOIN labels USING (doc_id)"
OBSERVATIONS_SQL = (
    f"SELECT {', '.join(_aliased(OBSERVATION_COLUMNS))}, CAST(o_orderdate AS DATE) AS date FROM orders"
)
ACTIVITY_SQL = (
    f"SELECT {EVENT_APP} AS app_id, count(DISTINCT user_id) AS players, "
    "CAST(min(ts) AS DATE) AS date FROM events GROUP BY event_type, date_trunc('hour', ts)"
)
ORDER_BASKETS_SQL = f"""
    SELECT {OBSERVATION_COLUMNS["app_id"]} AS app_id, o_orderkey AS basket_id,
           list_sort(list_distinct(list_concat(flatten(list(tags)),
               ['status_' || any_value(o_orderstatus), 'segment_' || any_value(c_mktsegment)]))) AS items
    FROM (SELECT l_orderkey, ['type_' || p_type, 'flag_' || l_returnflag || l_linestatus,
                              'brand_' || replace(p_brand, '#', '_')] AS tags
          FROM lineitem JOIN part ON l_partkey = p_partkey) lines
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY o_orderkey, o_orderpriority"""
