"""Oracle SQL for the registered queries, written independently of the Spark operators.

Where Spark takes the cheap way (one pass, partial aggregation, lookups by equality), the SQL
takes the obvious one: window functions, self-joins, full recomputation.
"""

from __future__ import annotations

from tidemark.functions import phrases as P
from tidemark.plans.inputs import ACTIVITY_SQL, AS_OF, OBSERVATIONS_SQL, ORDER_BASKETS_SQL, REVIEWS_SQL
from tidemark.schemas import BASKET_HARDWARE, BOOLEANS, PILLARS

DAY = 86400
METRICS = [
    "antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
]


def with_ctes(ctes: dict[str, str], final: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n" + final


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# --- KPIs -----------------------------------------------------------------------------------


def kpi_ctes(observations: str = OBSERVATIONS_SQL) -> dict[str, str]:
    return {
        "observed": observations,
        "days": """SELECT app_id, date, avg(players) AS mean_concurrent, median(players) AS median_concurrent,
                          max(players) AS peak_concurrent, min(players) AS min_concurrent
                   FROM observed GROUP BY app_id, date""",
        "changes": """SELECT *, lag(peak_concurrent) OVER (PARTITION BY app_id ORDER BY date) AS before FROM days""",
        "kpi_change": """SELECT * EXCLUDE (before),
                     CASE WHEN before IS NULL OR (before = 0 AND peak_concurrent = 0) THEN 0.0::DOUBLE
                          WHEN before = 0 THEN 'inf'::DOUBLE
                          ELSE (peak_concurrent::DOUBLE / before - 1) * 100 END AS pct_change FROM changes""",
        "kpis": """SELECT *, CASE WHEN pct_change >= 5 THEN 'retention_growth'
                                  WHEN pct_change <= -5 THEN 'retention_drop'
                                  ELSE 'retention_stable' END AS trend FROM kpi_change""",
    }


KPI_OUTPUT = (
    "app_id, date, " + rounded(["mean_concurrent", "median_concurrent"])
    + ", peak_concurrent, min_concurrent, " + rounded(["pct_change"]) + ", trend"
)


# --- Reviews and baskets --------------------------------------------------------------------


def review_ctes() -> dict[str, str]:
    return {"reviews": REVIEWS_SQL}


def tag_list() -> str:
    tags = [f"'{p}_' || {p}" for p in PILLARS]
    tags += [f"CASE WHEN {b} THEN '{b}_True' WHEN NOT {b} THEN '{b}_False' END" for b in BOOLEANS]
    tags.append(
        "CASE WHEN playtime_at_review < 120 THEN 'playtime_refund_zone' WHEN playtime_at_review < 600 THEN "
        "'playtime_casual' WHEN playtime_at_review < 3000 THEN 'playtime_mid_core' "
        "WHEN playtime_at_review < 12000 THEN 'playtime_heavy' "
        "WHEN playtime_at_review >= 12000 THEN 'playtime_hardcore' END"
    )
    tags.append("CASE WHEN language <> '' THEN 'lang_' || language END")
    for h in BASKET_HARDWARE:
        tags.append(
            f"CASE WHEN has_hardware_info AND {h} NOT IN ('N/A', 'Unknown') "
            f"THEN '{h}_' || replace({h}, ' ', '_') END"
        )
    tags.append("'kpi_' || trend")
    return f"list_sort(list_distinct([{', '.join(tags)}]))"


def basket_ctes() -> dict[str, str]:
    return {
        **review_ctes(),
        **kpi_ctes(),
        "tagged": f"""SELECT r.*, {tag_list()} AS items
                      FROM reviews r LEFT JOIN (SELECT app_id AS k_app, date AS k_date, trend FROM kpis) k
                      ON k_app = r.app_id AND k_date = CAST(epoch_ms(r.timestamp_updated::BIGINT * 1000) AS DATE)""",
    }


def window_ctes(min_reviews: int, window_days: int = 14, step_days: int = 7, max_days: int = 140) -> dict[str, str]:
    """Windows by plain range predicates."""
    return {
        "bounds": f"""SELECT i::INT AS window_no, {AS_OF} - i * {step_days * DAY} AS window_end,
                             {AS_OF} - i * {step_days * DAY} - {window_days * DAY} AS window_start
                      FROM range(0, {(max_days - window_days) // step_days + 1}) t(i)""",
        "windowed": """SELECT t.*, window_no, window_start, window_end FROM tagged t JOIN bounds
                       ON timestamp_updated >= window_start AND timestamp_updated < window_end
                       WHERE isSpam = FALSE""",
        "windows": f"""SELECT app_id, window_no, window_start, window_end, count(*) AS total_reviews
                       FROM windowed GROUP BY ALL HAVING count(*) >= {min_reviews}""",
    }


# --- Mining ---------------------------------------------------------------------------------


def itemset_ctes(baskets: str, min_support: float) -> dict[str, str]:
    """All frequent itemsets of ``baskets(grp, basket_id, items)`` by growing each basket's subsets.

    The recursion holds one row per basket and contained frequent itemset; its end is the end of
    the frequent itemsets, so no length limit is needed.
    """
    needed = f"ceil({min_support}::DOUBLE * n_baskets)"
    return {
        "baskets": baskets,
        "sizes": "SELECT grp, count(*) AS n_baskets FROM baskets GROUP BY grp",
        "basket_items": "SELECT grp, basket_id, unnest(items) AS item FROM baskets",
        "item_counts": "SELECT grp, item, count(*) AS item_count FROM basket_items GROUP BY grp, item",
        "usable": f"""SELECT grp, item FROM item_counts JOIN sizes USING (grp)
                      WHERE item_count <= floor(0.95::DOUBLE * n_baskets) AND item_count >= {needed}""",
        "held": "SELECT b.* FROM basket_items b JOIN usable USING (grp, item)",
        "grown": f"""SELECT grp, basket_id, [item] AS items, item AS last_item FROM held
                     UNION ALL
                     SELECT grp, basket_id, items, last_item FROM (
                        SELECT g.grp, g.basket_id, list_append(g.items, h.item) AS items, h.item AS last_item,
                               count(*) OVER (PARTITION BY g.grp, list_append(g.items, h.item)) AS c
                        FROM grown g JOIN held h
                        ON g.grp = h.grp AND g.basket_id = h.basket_id AND h.item > g.last_item
                     ) longer JOIN sizes USING (grp) WHERE c >= {needed}""",
        "itemsets": """SELECT grp, items, count(*) AS support_count, any_value(n_baskets) AS n_baskets
                       FROM grown JOIN sizes USING (grp) GROUP BY grp, items""",
    }


def rule_ctes(min_confidence: float, min_lift: float) -> dict[str, str]:
    return {
        "splits": """SELECT grp, items, support_count, n_baskets,
                            list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS ant,
                            list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS cons
                     FROM (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS mask
                           FROM itemsets WHERE len(items) >= 2)""",
        "rules": f"""SELECT grp, items, ant, cons,
                        a.support_count / n::DOUBLE AS antecedent_support,
                        c.support_count / n::DOUBLE AS consequent_support,
                        s.support_count / n::DOUBLE AS support,
                        s.support_count::DOUBLE / a.support_count AS confidence,
                        (s.support_count::DOUBLE * n) / (a.support_count::DOUBLE * c.support_count) AS lift,
                        s.support_count / n::DOUBLE
                            - (a.support_count / n::DOUBLE) * (c.support_count / n::DOUBLE) AS leverage,
                        CASE WHEN s.support_count < a.support_count THEN
                            (1 - c.support_count / n::DOUBLE) / (1 - s.support_count::DOUBLE / a.support_count)
                        END AS conviction
                     FROM (SELECT *, n_baskets AS n FROM splits) s
                     JOIN (SELECT grp, items AS ant, support_count FROM itemsets) a USING (grp, ant)
                     JOIN (SELECT grp, items AS cons, support_count FROM itemsets) c USING (grp, cons)
                     WHERE s.support_count::DOUBLE / a.support_count >= {min_confidence}
                       AND (s.support_count::DOUBLE * n) / (a.support_count::DOUBLE * c.support_count) >= {min_lift}::DOUBLE
                       AND NOT list_bool_and(list_transform(items, lambda x: starts_with(x, 'hw_')))""",
    }


def prune_ctes() -> dict[str, str]:
    best = "lift DESC, confidence DESC, support DESC, ant, cons"
    return {
        "by_pool": f"""SELECT * FROM rules
                       QUALIFY row_number() OVER (PARTITION BY grp, items ORDER BY {best}) = 1""",
        "by_ant": f"""SELECT * FROM by_pool
                      QUALIFY row_number() OVER (PARTITION BY grp, ant ORDER BY {best}) = 1""",
        "pruned": """SELECT * FROM by_ant s WHERE NOT EXISTS (
                        SELECT 1 FROM by_ant b WHERE b.grp = s.grp AND b.cons = s.cons
                        AND len(b.ant) < len(s.ant) AND list_has_all(s.ant, b.ant)
                        AND s.confidence - b.confidence < 0.05::DOUBLE)""",
    }


RULE_OUTPUT = (
    "list_aggregate(ant, 'string_agg', ' AND ') AS antecedents, "
    "list_aggregate(cons, 'string_agg', ' AND ') AS consequents, "
    + rounded([*METRICS, "conviction"])
)
REVIEW_GROUP = "SELECT app_id AS grp, recommendationid AS basket_id, items FROM tagged WHERE isSpam = FALSE"
ORDER_GROUP = f"SELECT app_id AS grp, basket_id, items FROM ({ORDER_BASKETS_SQL})"


# --- Reports --------------------------------------------------------------------------------


def values_cte(table: dict[str, str]) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in table.items())
    return f"SELECT * FROM (VALUES {rows}) v(key, phrase)"


def phrase_sql(tag: str) -> str:
    """A tag's phrase by scalar lookups into the dictionary tables of ``phrase_ctes``."""
    def found(cte: str, key: str) -> str:
        return f"(SELECT phrase FROM {cte} WHERE key = {key})"

    return f"""CASE
        WHEN starts_with({tag}, 'playtime_') THEN {found('d_playtime', f"substr({tag}, 10)")}
        WHEN starts_with({tag}, 'lang_') THEN 'wrote in ' || {found('d_language', f"substr({tag}, 6)")}
        WHEN starts_with({tag}, 'kpi_') THEN {found('d_trend', f"substr({tag}, 5)")}
        WHEN starts_with({tag}, 'hw_os_') THEN 'played on ' || replace(substr({tag}, 7), '_', ' ')
        WHEN starts_with({tag}, 'hw_ram_') THEN 'had ' || substr({tag}, 8) || ' of RAM'
        WHEN starts_with({tag}, 'hw_vram_') THEN 'had ' || substr({tag}, 9) || ' of VRAM'
        WHEN {tag} IN (SELECT key FROM d_boolean) THEN {found('d_boolean', tag)}
        ELSE 'rated the ' || {found('d_pillar', f"split_part({tag}, '_', 1)")} || ' ' || split_part({tag}, '_', 2) || '/5'
        END"""


def phrase_ctes() -> dict[str, str]:
    return {
        "d_playtime": values_cte(P.PLAYTIME_PHRASES),
        "d_language": values_cte(P.LANGUAGE_NAMES),
        "d_trend": values_cte(P.TREND_PHRASES),
        "d_boolean": values_cte(P.BOOLEAN_PHRASES),
        "d_pillar": values_cte(P.PILLAR_LABELS),
    }


def side_sql(items: str) -> str:
    """Phrases of a sorted list joined with commas and a final ``and``."""
    return f"""(SELECT CASE WHEN count(*) = 1 THEN any_value(p) ELSE
                   string_agg(p, ', ' ORDER BY i) FILTER (i < n) || ' and ' || any_value(p) FILTER (i = n) END
               FROM (SELECT {phrase_sql('t.tag')} AS p, t.i, len({items}) AS n
                     FROM (SELECT unnest({items}) AS tag, unnest(range(1, len({items}) + 1)) AS i) t))"""


# --- Matrix ---------------------------------------------------------------------------------

AVERAGES = {p: "avg_monetization" if p == "monetizationModel" else f"avg_{p}" for p in PILLARS}
REVIEW_FEATURES = ["daily_review_count", *AVERAGES.values(), "positive_ratio"]


def feature_ctes() -> dict[str, str]:
    means = ", ".join(f"avg({p}) AS {name}" for p, name in AVERAGES.items())
    return {
        "review_days": f"""SELECT app_id, CAST(epoch_ms(timestamp_updated::BIGINT * 1000) AS DATE) AS date,
                                  count(*) AS daily_review_count, {means},
                                  avg(CASE WHEN voted_up THEN 1.0 ELSE 0.0 END) AS positive_ratio
                           FROM reviews WHERE isSpam = FALSE GROUP BY ALL""",
    }


MATRIX_COLUMNS = [
    "mean_concurrent", "pct_change", *REVIEW_FEATURES, "kpi_lag_1", "kpi_lag_7", "kpi_lag_14",
    "kpi_roll_7_mean", "kpi_roll_7_max", "dayofweek", "is_weekend", "dow_sin", "dow_cos",
    "lag7_weekend_interaction", "weekend_boost_ratio", "target_y_abs", "target_y",
]


def matrix_ctes() -> dict[str, str]:
    """``matrix`` without rule features, from ``kpis`` and ``reviews``."""
    zeroed = ", ".join(f"coalesce({c}, 0) AS {c}" for c in REVIEW_FEATURES)
    over = "OVER (PARTITION BY app_id ORDER BY date)"
    week = "OVER (PARTITION BY app_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    return {
        **feature_ctes(),
        "lagged": f"""SELECT app_id, date, mean_concurrent, pct_change, {zeroed},
                             coalesce(lag(mean_concurrent, 1) {over}, 0) AS kpi_lag_1,
                             coalesce(lag(mean_concurrent, 7) {over}, 0) AS kpi_lag_7,
                             coalesce(lag(mean_concurrent, 14) {over}, 0) AS kpi_lag_14,
                             coalesce(avg(mean_concurrent) {week}, 0) AS kpi_roll_7_mean,
                             coalesce(max(mean_concurrent) {week}, 0) AS kpi_roll_7_max,
                             isodow(date) - 1 AS dayofweek,
                             CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
                             lead(mean_concurrent) {over} AS target_y_abs
                      FROM kpis LEFT JOIN review_days USING (app_id, date)""",
        "matrix": """SELECT *, sin(2 * pi() * dayofweek / 7.0) AS dow_sin, cos(2 * pi() * dayofweek / 7.0) AS dow_cos,
                            kpi_lag_7 * is_weekend AS lag7_weekend_interaction,
                            kpi_lag_7 / (kpi_roll_7_mean + 0.00001::DOUBLE) * is_weekend AS weekend_boost_ratio,
                            ln(target_y_abs / mean_concurrent) AS target_y
                     FROM lagged WHERE target_y_abs > 0 AND mean_concurrent > 0""",
    }
