"""Citation-shaped tables derived from the given tables, in SQL that Spark and DuckDB share.

Every document is a catalog work; the references cite the same works through seven kinds of
change (none, wrong year, wrong authors, wrong identifier, no identifier, shortened title,
invented). Fetch results come from pages, model answers from labels, cached results from
events. Placeholders in braces name tables; ARR( is the array constructor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATALOG, CHECK_CACHE, FETCH_LOG, MODEL_ANSWERS, REFS, conform

# FIRST<n>( ... ) is the text's first n fields between blanks; one pass over it in either dialect
TEXT = "replace(coalesce(d.text, ''), chr(10), ' ')"
TITLE, SHORT = (f"trim(FIRST{n}({TEXT}))" for n in (8, 5))
S = "AS STRING)"
ARXIV = f"('23' || lpad(CAST(d.doc_id % 12 + 1 {S}, 2, '0') || '.' || lpad(CAST(d.doc_id % 100000 {S}, 5, '0'))"
AUTHORS = "ARR(n1.n_name || ', A.', n2.n_name || ', B.')"
NATIONS = "JOIN {nation} n1 ON n1.n_nationkey = d.doc_id % 25 JOIN {nation} n2 ON n2.n_nationkey = (d.doc_id + 7) % 25"
SOURCE = "CASE d.doc_id % 4 WHEN 0 THEN 'Crossref' WHEN 1 THEN 'OpenAlex' WHEN 2 THEN 'Semantic Scholar' ELSE 'arXiv' END"

CATALOG_SQL = f"""
SELECT 'w' || CAST(d.doc_id {S} AS work_id, {SOURCE} AS source, CAST(d.doc_id % 4 + 1 AS INT) AS source_priority,
  {TITLE} AS title, {AUTHORS} AS authors, CAST(1990 + d.doc_id % 35 AS INT) AS year, 'Journal of ' || d.source AS venue,
  '10.5555/d' || CAST(d.doc_id {S} AS doi, CASE WHEN d.doc_id % 4 = 3 THEN {ARXIV} END AS arxiv_id,
  ARR('https://works.example.org/' || CAST(d.doc_id {S}) AS urls
FROM {{documents}} d {NATIONS}
"""

REFS_SQL = f"""
SELECT 'r' || CAST(d.doc_id {S} AS ref_id, 'b' || CAST(CAST(floor(d.doc_id / 20) AS BIGINT) {S} AS doc_id, CAST(d.doc_id AS INT) AS pos,
  CASE d.doc_id % 7 WHEN 5 THEN {SHORT} WHEN 6 THEN 'Zzyzx quux ' || CAST(d.doc_id {S} ELSE {TITLE} END AS title,
  CASE WHEN d.doc_id % 7 = 2 THEN ARR('Nobody, N.', 'Noone, M.') ELSE {AUTHORS} END AS authors,
  CAST(1990 + d.doc_id % 35 + CASE WHEN d.doc_id % 7 = 1 THEN 3 ELSE 0 END AS INT) AS year, 'Journal of ' || d.source AS venue,
  CASE WHEN d.doc_id % 7 = 3 THEN '10.9999/x' || CAST(d.doc_id {S} WHEN d.doc_id % 7 < 3 THEN '10.5555/D' || CAST(d.doc_id {S} || '/' END AS doi,
  CASE WHEN d.doc_id % 4 = 3 AND d.doc_id % 7 = 4 THEN {ARXIV} || 'v2' END AS arxiv_id,
  CASE WHEN d.doc_id % 7 = 5 THEN ARR('https://works.example.org/' || CAST(d.doc_id {S})
       WHEN d.doc_id % 7 = 0 THEN ARR(p.url, 'https://www.linkedin.com/in/' || CAST(d.doc_id {S})
       WHEN d.doc_id % 7 < 3 THEN ARR(p.url) END AS urls
FROM (SELECT *, doc_id % (SELECT count(*) FROM {{pages}}) AS page FROM {{documents}}) d {NATIONS} JOIN {{pages}} p ON p.page_id = d.page
"""

FETCH_SQL = f"""
SELECT DISTINCT url, status_code, final_url, body, error_kind, error FROM (
  SELECT url, CASE WHEN k IN (7, 8) THEN NULL WHEN k = 5 THEN 404 WHEN k = 6 THEN 403 WHEN k = 9 THEN 500 ELSE 200 END AS status_code,
    CASE WHEN k = 4 THEN url || '/moved' ELSE url END AS final_url, CASE WHEN k = 6 THEN 'Checking your browser' END AS body,
    CASE WHEN k = 7 THEN 'timeout' WHEN k = 8 THEN 'http' END AS error_kind, CASE WHEN k = 8 THEN 'reset' END AS error
  FROM (SELECT url, CAST(min(page_id) % 10 AS INT) AS k FROM {{pages}} GROUP BY url) x
  UNION ALL
  SELECT 'https://www.linkedin.com/in/' || CAST(doc_id {S}, 999, 'https://www.linkedin.com/in/' || CAST(doc_id {S}, NULL, NULL, NULL FROM {{documents}}
) y
"""

ANSWERS_SQL = f"""
SELECT 'r' || CAST(doc_id {S} AS ref_id,
  CASE WHEN doc_id % 11 = 0 THEN 'not json' WHEN toxic = 1 THEN '{{{{"label": "UNRELATED", "confidence": "0.8", "rationale": "Other topic."}}}}'
       WHEN quality = 0 THEN '{{{{"label": "PARTIAL", "confidence": 0.6, "rationale": "Same area."}}}}'
       ELSE '{{{{"label": "RELEVANT", "confidence": 0.9, "rationale": "Same work."}}}}' END AS response,
  CASE WHEN doc_id % 13 = 0 THEN 'unavailable' END AS error
FROM {{labels}}
"""

CACHE_SQL = f"""
SELECT 'existence' AS namespace, 'u' || CAST(user_id {S} AS identifier, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS status,
  value AS confidence, event_type AS evidence, ts AS created_at
FROM {{events}}
"""

TABLES = ("documents", "pages", "labels", "events", "nation")


def _first(sql: str, put: str) -> str:
    return re.sub(r"FIRST(\d)\(" + re.escape(TEXT) + r"\)", lambda m: put.format(text=TEXT, n=m[1]), sql)


def duck(sql: str) -> str:
    return _first(sql.format(**{t: t for t in TABLES}), "array_to_string(string_split({text}, ' ')[1:{n}], ' ')").replace("ARR(", "list_value(")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql.replace("{{", "").replace("}}", "")}
    text = _first(sql, "substring_index({text}, ' ', {n})").replace("ARR(", "array(")
    for t in used:
        text = text.replace("{" + t + "}", f"<{t}>")
    text = text.replace("{{", "{").replace("}}", "}")
    names = {t: f"derived_{t}" for t in used}
    for t, df in used.items():
        df.createOrReplaceTempView(names[t])
        text = text.replace(f"<{t}>", names[t])
    return spark.sql(text)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(frame(spark, sf_dir, CATALOG_SQL), CATALOG)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(frame(spark, sf_dir, REFS_SQL), REFS)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(frame(spark, sf_dir, FETCH_SQL), FETCH_LOG)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(frame(spark, sf_dir, ANSWERS_SQL), MODEL_ANSWERS)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, CACHE_SQL)
    return conform(rows.withColumn("key", F.sha2(F.concat_ws(":", "namespace", "identifier"), 256)), CHECK_CACHE)
