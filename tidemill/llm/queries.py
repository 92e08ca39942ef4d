"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import ann, bpe, decontaminate, langid, line_dedup, neardup, quality, secrets, sharding, token_counts
from tidemill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.listing(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.listing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.listing(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.listing(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.lengths(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _spans_sql(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, m, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM (
    SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(gaps[1:len(found)]) AS g, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (
        SELECT doc_id, regexp_split_to_array(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS found FROM texts)))"""


def _secrets_sql() -> str:
    """All spans, every window's entropy counted anew."""
    assign = secrets.ASSIGN.replace("'", "''")
    allowed = [p.replace("++", "+") for p in secrets.ALLOWED if "\\1" not in p]
    refused = " OR ".join(f"regexp_matches(m, '{p}')" for p in allowed)
    repeated = "len(list_filter(range(1, length(m) - 6), lambda i: m[i:i + 7] = repeat(m[i], 8))) > 0"
    limit = f"""CASE WHEN regexp_full_match(m, '[0-9a-f]+') OR regexp_full_match(m, '[0-9A-F]+') THEN {secrets.LIMITS['hex']} WHEN regexp_full_match(m, '[0-9A-Z]+') THEN {secrets.LIMITS['upper']}
    WHEN regexp_full_match(m, '[0-9A-Za-z]+') THEN {secrets.LIMITS['alnum']} ELSE {secrets.LIMITS['base64']} END"""
    names = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  base AS (SELECT * FROM ({_spans_sql(0, secrets.ASSIGN)}) WHERE length(regexp_extract(m, '{assign}', 2)) >= {secrets.ASSIGN_MIN}
    UNION ALL SELECT * FROM ({_spans_sql(1, secrets.ACCESS)}) WHERE length(m) >= {secrets.ACCESS_MIN}
    UNION ALL SELECT * FROM ({_spans_sql(2, secrets.HEX)}) WHERE length(m) >= {secrets.HEX_MIN}),
  words AS (SELECT * FROM ({_spans_sql(3, "[A-Za-z0-9+/_=-]{20,}")}) c WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({refused}) AND NOT {repeated}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
  windows AS (SELECT doc_id, s, m, unnest(range(1, length(m) - {secrets.WINDOW - 2})) AS pos FROM words),
  counts AS (SELECT doc_id, s, m, pos, x, count(*)::DOUBLE / {secrets.WINDOW} AS p FROM (SELECT doc_id, s, m, pos, unnest(string_split(m[pos:pos + {secrets.WINDOW - 1}], '')) AS x FROM windows) GROUP BY ALL),
  high AS (SELECT doc_id, s, any_value(m) AS m, max(h) AS h FROM (SELECT doc_id, s, m, pos, -sum(p * log2(p)) AS h FROM counts GROUP BY ALL) GROUP BY doc_id, s),
  spans AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, 3, s, s + length(m) FROM high WHERE h >= {limit}),
  listed AS (SELECT doc_id, string_agg(concat({names}, ':', s, ':', e), ',' ORDER BY s, kind) AS spans, string_agg(concat({names}, ':', s, ':', e), ',' ORDER BY s, kind) FILTER (kind < 3) AS base_spans,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM texts LEFT JOIN listed USING (doc_id)"""


QUERIES: dict[str, Query] = {
    name: query for name, query in globals().items() if name.startswith("op") and callable(query) and "_" in name
}
ORACLES: dict[str, str] = {
    "op2_secret_scan": _secrets_sql(),
    # exact, over all pairs that share a shingle
    "op4_near_duplicates": r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM sets s JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)""",
}
