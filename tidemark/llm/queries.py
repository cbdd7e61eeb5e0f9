"""The registered queries of this package: name -> query, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, collocations, decontamination, lexical_search, line_dedup, mixing, near_dups, ngram_lm, pii, quality, token_files,
    url_filters, warc,
)
from tidemark.llm.common import table, whole_text, written

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE, END_ID = "word_bpe_49k.json", 2
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(column: str):
        return F.array_join(F.transform(pii.in_order(F.col(column)), lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_tokens(docs, public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.read_tokens(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of the quality model: documents labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, trusted_ids(spark, sf_dir)).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def mirrored_keys(pages: DataFrame) -> DataFrame:
    """The list that the filter holds: host and path of pages whose html another page of a smaller id serves too."""
    rows = pages.select("page_id", F.sha2(whole_text("html"), 256).alias("digest"),
                        url_filters.url_key(url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))).alias("key"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(firsts, "digest").filter("page_id > first").select("key").distinct()


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge_urls(pages.select("page_id", "url"), URL_RULES, mirrored_keys(pages)).select(
        "page_id", "host", "path", "rule", "verdict")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", ngram_lm.held_out())
    trie = ngram_lm.train(docs.filter(~F.col("held_out")))
    return ngram_lm.score(docs, trie).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.vocabulary.total).cast("long").alias("train_tokens"),
        "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_line_dedup, op2_warc, op3_personal_data, op4_byte_bpe, op5_token_files, op6_quality_rules, op7_near_duplicates,
    op8_url_filters, op9_ngram_lm, op10_decontamination, op11_collocations,
    op12_lexical_search, op13_mixing)}

# --- Oracles ------------------------------------------------------------------------------------

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
          WHERE 100 * n >= 85 * (len(p.sh) + len(q.sh) - n)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, two.b FROM reach JOIN two ON two.a = reach.b)
SELECT s.doc_id, len(sh) AS n_shingles, min(b) AS component_id, s.doc_id = min(b) AS kept
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, sh"""

_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
URL_FILTERS_SQL = f"""
WITH u AS (SELECT page_id, html, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) AS again FROM u),
listed AS (SELECT DISTINCT host || path AS key FROM f WHERE again),
rules(action, rule_host, rule_path) AS (VALUES {_RULES}),
fitting AS (SELECT page_id, rule_host || rule_path AS rule, action FROM u JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM fitting GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
items AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram
          FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes)),
hits AS (SELECT doc_id, item_id, p, grams.n FROM grams JOIN windows USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names
          FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

COLLOCATIONS_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g, count(*) AS n FROM s GROUP BY ALL),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, g, n AS a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND n >= 100),
cuts AS (SELECT c.lang, c.k, c.g, c.a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c),
weighed AS (SELECT cuts.*, l.n AS l, r.n AS r, z.n AS n, ((1000::HUGEINT * a * z.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
            FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = x JOIN f r ON r.lang = cuts.lang AND r.g = y
            JOIN sizes z ON z.lang = cuts.lang),
weakest AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
own AS (SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = x.lang AND c.k > x.k AND 100 * c.a >= 100 * x.a
            AND contains(' ' || c.g || ' ', ' ' || x.g || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM own QUALIFY rank <= 2000"""

LEXICAL_SEARCH_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
corpus AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS terms FROM t WHERE len(ws) > 0),
tf AS (SELECT row, doc_id, len(ws) AS len, term, count(*) AS tf FROM (SELECT row, doc_id, ws, unnest(ws) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")},
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
parts AS (SELECT item_id, row, doc_id, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT
            * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * docs) // terms))) AS part
          FROM asked JOIN df USING (term) JOIN tf USING (term), corpus),
scored AS (SELECT item_id, row, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored QUALIFY rank <= 50"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP_SQL, "op2_warc": WARC_SQL, "op7_near_duplicates": NEAR_DUPLICATES_SQL,
    "op8_url_filters": URL_FILTERS_SQL, "op10_decontamination": DECONTAMINATION_SQL,
    "op11_collocations": COLLOCATIONS_SQL, "op12_lexical_search": LEXICAL_SEARCH_SQL,
}
