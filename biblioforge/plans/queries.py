"""Registered queries over derived tables, each with the same result in plain SQL where SQL
can express it. Round trips render works as bibliography files and parse them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import cache as K
from ..operators import checks as C
from ..operators import matching as M
from ..operators import plaintext as P
from ..operators import summary as A
from ..operators.key_index import build_keys, open_keys
from ..operators.title_index import build_index, open_index, search_index
from ..schemas import CATALOG, REFS, Source, conform, priority, sources
from ..sources import catalog as G
from ..sources import formats, sinks
from ..storage import delete, discard, keep, shared_path
from . import derived as D
from .verify import Options, Run, verify, verify_incremental

CAT, REF, LOG, ANS, CACHE = (f"({D.duck(s)})" for s in (D.CATALOG_SQL, D.REFS_SQL, D.FETCH_SQL, D.ANSWERS_SQL, D.CACHE_SQL))
EXACT = Options(search=False, domain_mode="none")


def j3_doi_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup_doi(D.refs(spark, sf), D.catalog(spark, sf))


def j4_arxiv_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup_arxiv(D.refs(spark, sf), D.catalog(spark, sf))


def j7_url_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup_url(D.refs(spark, sf), D.catalog(spark, sf))


def j9_exact_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return M.cascade(D.refs(spark, sf), D.catalog(spark, sf), "none", search=False)


DOI_HITS = f"""SELECT r.ref_id, c.work_id, c.source, 'doi' AS via, 1 AS rank FROM {REF} r JOIN {CAT} c ON rtrim(lower(r.doi), '/') = lower(c.doi)"""
ARXIV_HITS = f"""SELECT r.ref_id, c.work_id, c.source, 'arxiv_id' AS via, 1 AS rank
FROM {REF} r JOIN (SELECT source, arxiv_id, min(work_id) AS work_id FROM {CAT} WHERE arxiv_id IS NOT NULL GROUP BY 1, 2) c ON regexp_replace(r.arxiv_id, 'v[0-9]+$', '') = c.arxiv_id"""
URL_HITS = f"""SELECT ref_id, work_id, source, 'url' AS via, 1 AS rank FROM (
SELECT r.ref_id, c.work_id, c.source, row_number() OVER (PARTITION BY r.ref_id ORDER BY c.source_priority, c.work_id) AS k
FROM (SELECT ref_id, unnest(urls) AS url FROM {REF}) r JOIN (SELECT work_id, source, source_priority, unnest(urls) AS url FROM {CAT}) c ON r.url = c.url) WHERE k = 1"""
EXACT_HITS = f"""SELECT * FROM ({DOI_HITS}) UNION ALL SELECT * FROM ({ARXIV_HITS}) a WHERE ref_id NOT IN (SELECT ref_id FROM ({DOI_HITS}))
UNION ALL SELECT * FROM ({URL_HITS}) u WHERE ref_id NOT IN (SELECT ref_id FROM ({DOI_HITS}) UNION ALL SELECT ref_id FROM ({ARXIV_HITS}))"""


def j5_title_search(spark: SparkSession, sf: str) -> DataFrame:
    return M.search_titles(D.refs(spark, sf), D.catalog(spark, sf), F.array(*map(F.lit, sources("core")))).select("ref_id", "work_id", "source", "rank")


TOKENS = "list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'))"


def _title_search_sql(works: str, refs: str, may: str) -> str:
    """All pairs that share a token, without blocks. ``may`` is what else a pair has to fulfil."""
    return f"""
WITH c AS (SELECT *, {TOKENS} AS tk FROM {works} WHERE length(title) > 0), r AS (SELECT *, {TOKENS} AS tk FROM {refs} WHERE length(title) > 0),
ct AS (SELECT source, work_id, unnest(tk) AS token FROM c), n AS (SELECT source, count(*) AS total FROM c GROUP BY 1),
df AS (SELECT source, token, round(ln(1 + total / df) * 1e6)::BIGINT AS idf FROM (SELECT source, token, count(*) AS df FROM ct GROUP BY 1, 2) JOIN n USING (source)),
rt AS (SELECT ref_id, n.source, token, idf, coalesce(idf, round(ln(1 + total) * 1e6)::BIGINT) AS weight FROM (SELECT ref_id, unnest(tk) AS token FROM r) CROSS JOIN n LEFT JOIN df USING (source, token)),
rw AS (SELECT ref_id, source, sum(weight) AS rw FROM rt GROUP BY 1, 2), ww AS (SELECT source, work_id, sum(idf) AS ww FROM ct JOIN df USING (source, token) GROUP BY 1, 2),
s AS (SELECT ref_id, source, work_id, sum(idf) AS weight FROM rt JOIN ct USING (source, token) WHERE idf IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT s.* FROM s JOIN rw USING (ref_id, source) JOIN ww USING (source, work_id) JOIN r USING (ref_id) JOIN c USING (work_id)
  WHERE 2 * s.weight >= least(rw, ww) AND ({may}))
SELECT ref_id, work_id, source, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, source ORDER BY weight DESC, work_id) AS rank FROM w) WHERE rank <= 5
"""


TITLE_SEARCH = _title_search_sql(CAT, REF, "s.source <> 'OpenAlex' OR c.year = r.year OR r.year IS NULL")


def m2_m3_scores(spark: SparkSession, sf: str) -> DataFrame:
    r, c = D.refs(spark, sf), D.catalog(spark, sf)
    both = r.select("ref_id", F.col("authors").alias("ra"), F.col("year").alias("ry")).join(c.select(F.concat(F.lit("r"), F.substring("work_id", 2, 30)).alias("ref_id"), F.col("authors").alias("ca"), F.col("year").alias("cy")), "ref_id")
    return both.select("ref_id", S.author_overlap(F.col("ra"), F.col("ca")).alias("overlap"), S.year_score(F.col("ry"), F.col("cy")).alias("year_score"))


OVERLAP = "CASE WHEN len(a) < len(b) * 0.5 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END"
SCORES = f"""
WITH p AS (SELECT r.ref_id, list_distinct(list_transform(r.authors, lambda x: lower(split_part(x, ',', 1)))) AS a, list_distinct(list_transform(c.authors, lambda x: lower(split_part(x, ',', 1)))) AS b,
  abs(r.year - c.year) AS gap FROM {REF} r JOIN {CAT} c ON 'r' || substr(c.work_id, 2) = r.ref_id)
SELECT ref_id, {OVERLAP} AS overlap,
  CASE gap WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS year_score FROM p
"""


def c3_url_status(spark: SparkSession, sf: str) -> DataFrame:
    return C.url_status(D.fetch_log(spark, sf)).select("url", "result.status", "result.status_code", "result.redirected", "result.error")


URL_STATUS = f"""
SELECT url, CASE WHEN error_kind = 'timeout' THEN 'WARN' WHEN error_kind IS NOT NULL THEN 'FAIL' WHEN url LIKE 'https://www.linkedin.com/%' OR (status_code = 403 AND lower(body) LIKE '%checking your browser%') THEN 'SKIPPED'
  WHEN status_code BETWEEN 200 AND 299 THEN 'PASS' ELSE 'FAIL' END AS status, status_code, CASE WHEN error_kind IS NULL THEN final_url <> url END AS redirected,
  CASE WHEN error_kind = 'timeout' THEN 'timeout' WHEN error_kind IS NOT NULL THEN error WHEN url LIKE 'https://www.linkedin.com/%' OR status_code IN (200, 403) THEN NULL ELSE 'HTTP ' || status_code END AS error
FROM {LOG}
"""


def c5_url_audit(spark: SparkSession, sf: str) -> DataFrame:
    return C.check_urls(D.refs(spark, sf), C.url_status(D.fetch_log(spark, sf))).select("ref_id", "url_liveness.status", "url_liveness.confidence", "url_liveness.total_urls")


URL_AUDIT = f"""
WITH s AS ({URL_STATUS}), u AS (SELECT ref_id, unnest(urls) AS url FROM {REF}),
g AS (SELECT ref_id, count(*) AS n, bool_or(status = 'FAIL') AS f, bool_or(status = 'WARN') AS w, bool_and(status = 'SKIPPED') AS k
      FROM (SELECT ref_id, coalesce(status, 'WARN') AS status FROM u LEFT JOIN s USING (url)) GROUP BY 1)
SELECT r.ref_id, CASE WHEN n IS NULL THEN 'SKIPPED' WHEN f THEN 'FAIL' WHEN w THEN 'WARN' WHEN k THEN 'SKIPPED' ELSE 'PASS' END AS status,
  (CASE WHEN n IS NULL THEN 1.0 WHEN f THEN 0.9 WHEN w THEN 0.7 WHEN k THEN 0.5 ELSE 0.95 END)::DOUBLE AS confidence, coalesce(n, 0)::INT AS total_urls
FROM {REF} r LEFT JOIN g USING (ref_id)
"""


def _pages_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").groupBy("url").agg(F.min("html").alias("text")).select("url", F.lit(200).alias("status_code"), "text")


def c7_relevance(spark: SparkSession, sf: str) -> DataFrame:
    inputs = C.relevance_inputs(D.refs(spark, sf), _pages_text(spark, sf))
    return C.check_relevance(inputs, D.answers(spark, sf)).select("ref_id", "relevance.status", "relevance.confidence", "relevance.label")


RELEVANCE = f"""
WITH x AS (SELECT r.ref_id, r.title, r.doi, p.url IS NOT NULL AS has, a.ref_id IS NOT NULL AS answered, a.response, a.error
  FROM {REF} r LEFT JOIN (SELECT DISTINCT url FROM pages) p ON p.url = r.urls[1] LEFT JOIN {ANS} a USING (ref_id)),
y AS (SELECT ref_id, CASE WHEN title = '' AND doi IS NULL THEN 'skip' WHEN NOT has THEN 'none' WHEN error IS NOT NULL THEN 'error' WHEN response = 'not json' THEN 'parse'
  WHEN response LIKE '%UNRELATED%' THEN 'UNRELATED' WHEN response LIKE '%PARTIAL%' THEN 'PARTIAL' ELSE 'RELEVANT' END AS k FROM x WHERE answered OR NOT has OR (title = '' AND doi IS NULL))
SELECT ref_id, CASE k WHEN 'skip' THEN 'SKIPPED' WHEN 'UNRELATED' THEN 'FAIL' WHEN 'RELEVANT' THEN 'PASS' ELSE 'WARN' END AS status,
  (CASE k WHEN 'skip' THEN 0.0 WHEN 'none' THEN 0.3 WHEN 'error' THEN 0.1 WHEN 'parse' THEN 0.2 WHEN 'UNRELATED' THEN 0.8 WHEN 'PARTIAL' THEN 0.6 ELSE 0.9 END)::DOUBLE AS confidence,
  CASE WHEN k = 'none' THEN 'CANNOT_DETERMINE' WHEN k IN ('UNRELATED', 'PARTIAL', 'RELEVANT') THEN k END AS label FROM y
"""


def a3_unparsed(spark: SparkSession, sf: str) -> DataFrame:
    return A.unparsed(D.refs(spark, sf).withColumn("title", F.when(F.col("pos") % 4 > 0, F.col("title"))))


UNPARSED = f"SELECT count(*) FILTER ((coalesce(title, '') = '' OR pos % 4 = 0) AND doi IS NULL AND arxiv_id IS NULL) AS unparsed FROM {REF}"


def _exact_reports(spark: SparkSession, sf: str) -> DataFrame:
    return verify(D.refs(spark, sf), D.catalog(spark, sf), D.fetch_log(spark, sf), opts=EXACT)


def c9_exact_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _exact_reports(spark, sf).select("ref_id", "verdict", F.array_join("notes", " / ").alias("notes"), "existence.work_id", F.col("existence.status").alias("existence_status"))


TWO = "'[''' || array_to_string({}[1:2], ''', ''') || ''']'"
# hits by identifier score 1; those by link only have the same year, authors and venue and a title that begins the work's
VERDICTS = f"""
WITH h AS ({EXACT_HITS}), u AS ({URL_AUDIT}),
x AS (SELECT r.*, h.work_id, h.via, c.year AS cy, c.doi AS cdoi, c.authors AS ca, u.status AS us, len(coalesce(r.urls, [])) AS nu FROM {REF} r LEFT JOIN h USING (ref_id) LEFT JOIN {CAT} c USING (work_id) JOIN u USING (ref_id)),
o AS (SELECT *, {OVERLAP} AS overlap FROM (SELECT *, list_distinct(list_transform(authors, lambda z: lower(split_part(z, ',', 1)))) AS a, list_distinct(list_transform(ca, lambda z: lower(split_part(z, ',', 1)))) AS b FROM x)),
m AS (SELECT *, list_filter([CASE WHEN abs(year - cy) > 2 THEN 'year: cited=' || year || ', found=' || cy END, CASE WHEN trim(lower(doi), '/') <> lower(cdoi) THEN 'doi: cited=' || doi || ', found=' || cdoi END,
  CASE WHEN overlap < 0.3 THEN 'authors: low overlap (' || printf('%.2f', overlap) || '), cited=' || {TWO.format('authors')} || ', found=' || {TWO.format('ca')} END], lambda z: z IS NOT NULL) AS mm FROM o),
v AS (SELECT *, CASE WHEN work_id IS NULL THEN 'NOT_FOUND' WHEN len(mm) > 0 THEN 'METADATA_MISMATCH' WHEN nu > 0 AND us = 'FAIL' THEN 'DEAD_URL' ELSE 'VERIFIED' END AS verdict FROM m)
SELECT ref_id, verdict, work_id, CASE WHEN work_id IS NULL THEN 'FAIL' WHEN len(mm) > 0 THEN 'WARN' ELSE 'PASS' END AS existence_status,
  CASE verdict WHEN 'NOT_FOUND' THEN '{C.NOTES["not_found"]}' WHEN 'DEAD_URL' THEN '{C.NOTES["dead"]}'
    WHEN 'METADATA_MISMATCH' THEN 'Metadata mismatches found: ' || array_to_string(mm, '; ') || CASE WHEN nu > 0 AND us = 'FAIL' THEN ' / {C.NOTES["also_dead"]}' ELSE '' END
    ELSE CASE WHEN nu > 0 AND us = 'WARN' THEN '{C.NOTES["slow"]}' ELSE '' END END AS notes FROM v
"""


def a1_summary_by_document(spark: SparkSession, sf: str) -> DataFrame:
    reports = _exact_reports(spark, sf)
    return A.summary(reports, "doc_id").join(A.gate(reports, "doc_id"), "doc_id")


def a4_rate_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return A.rate_by_year(_exact_reports(spark, sf)).select("year", "total", F.round("verified_share", 6).alias("verified_share"))


def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade with title search, links and model answers."""
    reports = verify(D.refs(spark, sf), D.catalog(spark, sf), D.fetch_log(spark, sf), _pages_text(spark, sf), D.answers(spark, sf), Options(check_relevance=True))
    return reports.groupBy("verdict").agg(F.count("*").alias("references"))


def s19_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.markdown(_exact_reports(spark, sf))


# as above: a hit that passes scores 1, one with mismatches 0.85 at most
MARKDOWN = f"""
WITH v AS ({VERDICTS}), u AS (SELECT ref_id, status, confidence FROM ({URL_AUDIT}))
SELECT doc_id, pos, concat_ws(chr(10), '## ' || coalesce(nullif(title, ''), '(unknown)'), '**Verdict:** ' || CASE verdict WHEN 'NOT_FOUND' THEN 'could not verify — likely fabricated, needs manual review' ELSE verdict END, '**DOI:** ' || doi,
  CASE WHEN notes <> '' THEN '**Notes:**' || chr(10) || '- ' || replace(notes, ' / ', chr(10) || '- ') END,
  '- `existence`: ' || existence_status || ' (confidence=' || CASE existence_status WHEN 'PASS' THEN '1.00' WHEN 'WARN' THEN '0.85' ELSE CASE WHEN title = '' AND doi IS NULL THEN '0.50' ELSE '0.90' END END || ')',
  CASE WHEN len(urls) > 0 THEN '- `url_liveness`: ' || status || ' (confidence=' || printf('%.2f', confidence) || ')' END) AS markdown
FROM v JOIN u USING (ref_id) JOIN {REF} r USING (ref_id)
"""


def w1_best_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as hits of their order: few scores, so that most orders have ties."""
    tiers = F.array(*map(F.lit, ("doi", "arxiv_id", "title", "pmid", "url")))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("source", F.element_at(F.array(*map(F.lit, sources())), (F.col("l_suppkey") % 7 + 1).cast("int")))
    hits = rows.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("ref_id"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("work_id"), "source",
        F.element_at(tiers, (F.col("l_partkey") % 5 + 1).cast("int")).alias("via"), (F.col("l_linenumber") % 3).cast("int").alias("rank"), priority(F.col("source")).alias("source_priority"),
        F.round(F.col("l_tax").cast("double"), 2).alias("title_score"), (F.floor(F.col("l_quantity") / 20) / 4).cast("double").alias("composite"),
    )
    return M.best_hits(hits).select("ref_id", "work_id", "composite", "n_candidates")


BEST_HITS = """
WITH h AS (SELECT 'r' || l_orderkey AS ref_id, 'w' || l_partkey AS work_id, (l_suppkey % 7 + 1)::INT AS priority, (l_partkey % 5 + 1)::INT AS tier, l_linenumber % 3 AS rank, (floor(l_quantity / 20) / 4)::DOUBLE AS composite FROM lineitem)
SELECT ref_id, work_id, composite, n_candidates FROM (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n_candidates,
  row_number() OVER (PARTITION BY ref_id ORDER BY composite DESC, CASE WHEN priority > 4 THEN 4 ELSE tier END, priority, rank, work_id) AS k FROM h) WHERE k = 1
"""


def k2_fresh_results(spark: SparkSession, sf: str) -> DataFrame:
    cache = D.cache(spark, sf)
    wanted = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("identifier")).withColumn("key", K.key(F.lit("existence"), F.col("identifier")))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    hit, miss = K.lookup(wanted, cache, now)
    return hit.select("identifier", "status", "confidence", "evidence").unionByName(miss.select("identifier"), allowMissingColumns=True)


FRESH = f"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY created_at DESC, status DESC, confidence DESC, evidence DESC) AS k FROM {CACHE}) WHERE k = 1
  AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(created_at) <= (CASE WHEN status = 'FAIL' THEN 1 ELSE 30 END) * 86400000000)
SELECT w.identifier, l.status, l.confidence, l.evidence FROM (SELECT 'u' || c_custkey AS identifier FROM customer) w LEFT JOIN l USING (identifier)
"""


def k4_purged_cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.purge(D.cache(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("confidence"))


def k1_identities(spark: SparkSession, sf: str) -> DataFrame:
    r = D.refs(spark, sf)
    return r.select("ref_id", *(K.key(F.lit(n), K.identity(n)).alias(n) for n in ("existence", "relevance")))


IDENTITIES = f"""
WITH i AS (SELECT ref_id, coalesce(doi, arxiv_id, nullif(title, '') || '|' || year) AS e, coalesce(doi, nullif(title, '') || '|' || coalesce(urls[1], '')) AS v FROM {REF})
SELECT ref_id, sha256('existence:' || e) AS existence, sha256('relevance:' || v) AS relevance FROM i
"""


def j8_routing(spark: SparkSession, sf: str) -> DataFrame:
    return D.refs(spark, sf).select("ref_id", F.array_join(M.routed(), ",").alias("sources"))


def c12_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return _exact_reports(spark, sf).where("enriched IS NOT NULL").select("ref_id", "enriched.title", "enriched.year", "enriched.venue", "enriched.doi")


ENRICHED = f"""
SELECT ref_id, CASE WHEN r.title = '' THEN nullif(c.title, '') ELSE r.title END AS title, r.year, r.venue, coalesce(r.doi, c.doi) AS doi FROM {REF} r JOIN ({EXACT_HITS}) h USING (ref_id) JOIN {CAT} c USING (work_id) WHERE r.doi IS NULL
"""

# Round trips: works rendered as files, twenty to a file, and parsed back.


def _rendered(spark: SparkSession, sf: str, entry: str, join: str = "\n", around: tuple[str, str] = ("", ""), works: int = 20) -> DataFrame:
    """Files (doc_id, text) of ``works`` numbers each, so that their count grows with the catalog."""
    c = D.catalog(spark, sf).where("title IS NOT NULL").withColumn("n", F.substring("work_id", 2, 30).cast("long"))
    rows = c.select(F.floor(F.col("n") / works).alias("doc_id"), F.struct("n", F.expr(entry).alias("e")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["e"]), join)
    return rows.groupBy("doc_id").agg(F.concat(F.lit(around[0]), body, F.lit(around[1])).alias("text"))


FIELDS = ("title", "authors", "year", "venue", "doi")


def _fields(refs: DataFrame) -> DataFrame:
    return refs.select(*(F.array_join("authors", "; ").alias(f) if f == "authors" else F.col(f) for f in FIELDS))


FIELDS_SQL = f"SELECT title, array_to_string(authors, '; ') AS authors, year, venue, doi FROM {CAT} WHERE length(title) > 0"


def s3_bibtex(spark: SparkSession, sf: str) -> DataFrame:
    entry = (
        "concat('@article{k', n, ',\n  title = {{', title, '}},\n  author = {', array_join(authors, if(n % 2 = 0, ' and ', '\n    AND ')), '},\n  journal = \"', venue, '\",\n  year = ', year, "
        "',\n  doi = {', doi, '},\n  pmid = {', n, '}', if(n % 3 = 0, concat(',\n  eprint = {2301.', n, ' [cs.DL]}'), if(n % 3 = 1, concat(',\n  url = {https://arxiv.org/abs/math/', n, '/x}'), '')), '\n}')"
    )
    refs = formats.parse_bibtex(_rendered(spark, sf, entry))
    return refs.select("pmid", "arxiv_id", "raw", *(F.array_join("authors", "; ").alias(f) if f == "authors" else F.col(f) for f in FIELDS))


N = "substr(work_id, 2)::BIGINT"
BIBTEX = f"""SELECT title, array_to_string(authors, '; ') AS authors, year, venue, doi, {N}::STRING AS pmid, CASE {N} % 3 WHEN 0 THEN '2301.' || {N} WHEN 1 THEN 'math' END AS arxiv_id,
  title || ' ' || array_to_string(authors[1:2], ' ') || ' ' || year || ' ' || venue AS raw FROM {CAT} WHERE length(title) > 0"""


def s4_ris(spark: SparkSession, sf: str) -> DataFrame:
    entry = "concat('TY  - JOUR\nTI  - ', title, '\nAU  - ', array_join(authors, '\nAU  - '), '\nPY  - ', year, '\nJO  - ', venue, '\nDO  - ', doi, '\nUR  - ', urls[0], '\nER  - ')"
    return _fields(formats.parse_ris(_rendered(spark, sf, entry)))


def s5_csl_json(spark: SparkSession, sf: str) -> DataFrame:
    entry = (
        "to_json(named_struct('title', title, 'author', transform(authors, a -> named_struct('literal', a)), 'issued', named_struct('date-parts', array(array(year))), 'container-title', venue, 'DOI', doi))"
    )
    return _fields(formats.parse_csl_json(_rendered(spark, sf, entry, ",\n", ("[", "]"))))


def s6_nbib(spark: SparkSession, sf: str) -> DataFrame:
    entry = "concat('PMID- ', n, '\nTI  - ', title, '\nAU  - ', array_join(authors, '\nAU  - '), '\nJT  - ', venue, '\nDP  - ', year, ' Jan\nLID - ', doi, ' [doi]\n')"
    return _fields(formats.parse_nbib(_rendered(spark, sf, entry)))


def s7_doi_list(spark: SparkSession, sf: str) -> DataFrame:
    return formats.parse_doi_list(_rendered(spark, sf, "concat('https://doi.org/', doi, '.')")).select("doi")


def s9_s10_s11_catalog(spark: SparkSession, sf: str) -> DataFrame:
    c = D.catalog(spark, sf)
    openalex = c.where("source = 'OpenAlex'").select(
        F.expr("to_json(named_struct('id', work_id, 'title', title, 'doi', concat('https://doi.org/', doi), 'publication_year', year, 'authorships', transform(authors, a -> named_struct('author', named_struct('display_name', a))), 'primary_location', named_struct('source', named_struct('display_name', venue))))").alias("payload")
    )
    crossref = c.where("source = 'Crossref'").select(
        F.expr("to_json(named_struct('DOI', doi, 'title', array(title), 'author', transform(authors, a -> named_struct('family', a)), 'issued', named_struct('date-parts', array(array(year))), 'container-title', array(venue)))").alias("payload")
    )
    semantic = c.where("source = 'Semantic Scholar'").select(
        F.expr("to_json(named_struct('paperId', work_id, 'title', title, 'year', year, 'venue', venue, 'authors', transform(authors, a -> named_struct('name', a)), 'externalIds', named_struct('DOI', doi)))").alias("payload")
    )
    made = G.union_catalog({"OpenAlex": openalex, "Crossref": crossref, "Semantic Scholar": semantic})
    return made.select("source", "source_priority", *(F.array_join("authors", "; ").alias(f) if f == "authors" else F.col(f) for f in FIELDS))


MAPPED = f"SELECT source, CASE source WHEN 'Crossref' THEN 1 WHEN 'OpenAlex' THEN 2 ELSE 3 END::INT AS source_priority, nullif(title, '') AS title, array_to_string(authors, '; ') AS authors, year, venue, doi FROM {CAT} WHERE source IN ('OpenAlex', 'Crossref') OR (source = 'Semantic Scholar' AND length(title) > 0)"


def p19_mined_references(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, each ending in a list of references (its own work's), mined for their fields."""
    entry = "concat('[1] A. Smith, ', split(authors[0], ',')[0], ', \"', regexp_replace(title, '\"', ''), ' 0123456789\" in ', venue, ', ', year, '. doi:', doi, '.')"
    lists = _rendered(spark, sf, entry, works=1)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    ending = F.coalesce(F.concat(F.lit("\n\n## References\n\n"), "text", F.lit("\n")), F.lit(""))
    whole = docs.join(lists, "doc_id", "left").select("doc_id", F.concat("body", ending).alias("text"))
    return P.mine_documents(whole).where("doi IS NOT NULL").select("title", "year", "doi")


MINED = f"SELECT regexp_replace(title, '\"', '', 'g') || ' 0123456789' AS title, year, doi FROM {CAT} WHERE length(title) > 0"

PLAIN = "trim(concat(regexp_replace(title, '[^A-Za-z0-9]+', ' '), ' x'))"


def _styled(spark: SparkSession, sf: str, entry: str) -> DataFrame:
    refs = P.parse_lists(_rendered(spark, sf, entry, "\n\n"))
    return refs.select("title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi")


def p12_apa_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _styled(spark, sf, f"concat('Smith, A., Jones, B. (', year, '). ', {PLAIN}, '. Journal. doi:', doi, '.')")


def p13_vancouver_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _styled(spark, sf, f"concat('Smith A, Jones B. ', {PLAIN}, '. Journal. ', year, ';12(3):45-67. doi:', doi, '.')")


def p14_lncs_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _styled(spark, sf, f"concat('Smith, A., Jones, B.: ', {PLAIN}, '. ', venue, ' (', year, '). doi:', doi, '.')")


def _styled_sql(authors: str, venue: str) -> str:
    return f"SELECT trim(regexp_replace(title || ' x', '[^A-Za-z0-9]+', ' ', 'g')) AS title, '{authors}' AS authors, year, {venue} AS venue, doi FROM {CAT} WHERE length(title) > 0"


def k3_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.cache(spark, sf)
    late = F.col("created_at") >= F.lit("2024-01-10 00:00:00").cast("timestamp")
    return K.upsert(rows.where(~late), rows.where(late)).select("identifier", "status", "confidence", "evidence")


UPSERT = f"""SELECT identifier, status, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY created_at DESC, status DESC, confidence DESC, evidence DESC) AS k FROM {CACHE}) WHERE k = 1"""


def s16_open_access(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.expr("to_json(named_struct('doi', doi, 'best_oa_location', named_struct('url_for_pdf', if(year % 2 = 0, concat(urls[0], '.pdf'), null), 'url', urls[0])))").alias("payload")
    return G.open_access(D.refs(spark, sf), D.catalog(spark, sf).select(payload)).select("ref_id", "oa_url")


OPEN_ACCESS = f"SELECT ref_id, CASE WHEN c.year % 2 = 0 THEN c.urls[1] || '.pdf' ELSE c.urls[1] END AS oa_url FROM {REF} r LEFT JOIN {CAT} c ON rtrim(lower(r.doi), '/') = lower(c.doi)"


def p20_recovery_prompts(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("ref_id"), F.col("text").alias("raw"))
    return P.recovery_prompts(conform(raw, REFS)).select("ref_id", F.md5("prompt").alias("prompt"))


HEAD, TAIL = (x.replace("'", "''") for x in P.RECOVERY_PROMPT.split("%s"))
PROMPTS = f"SELECT CAST(doc_id AS STRING) AS ref_id, md5('{HEAD}' || text || '{TAIL}') AS prompt FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')"


def p21_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """Answers, some fenced or broken, merged into the references that they may replace."""
    r = D.refs(spark, sf).withColumn("title", F.when(F.col("pos") % 2 == 0, F.col("title")))
    said = F.expr("concat('```json\n', to_json(named_struct('title', if(pos % 3 = 0, null, concat('Answer ', pos)), 'year', cast(year as string), 'doi', if(pos % 5 = 0, concat('10.7777/', pos), null))), '\n```')")
    answers = r.select("ref_id", F.when(F.col("pos") % 7 == 0, F.lit("not json")).otherwise(said).alias("response"))
    return P.merge_recovered(r, answers).select("ref_id", "title", "year", "doi")


RECOVERED = f"""
WITH r AS (SELECT *, CASE WHEN pos % 2 = 0 THEN nullif(title, '') END AS t, CASE WHEN pos % 7 > 0 AND pos % 3 > 0 THEN 'Answer ' || pos END AS said_title, CASE WHEN pos % 7 > 0 AND pos % 5 = 0 THEN '10.7777/' || pos END AS said_doi FROM {REF}),
u AS (SELECT *, t IS NULL AND doi IS NULL AND arxiv_id IS NULL AND (said_title IS NOT NULL OR said_doi IS NOT NULL) AS used FROM r)
SELECT ref_id, CASE WHEN used THEN said_title ELSE t END AS title, year, CASE WHEN used THEN said_doi ELSE doi END AS doi FROM u
"""

# Works of domain sources, one for every third document, cited by PubMed id, identifier or title.
DOMAIN_SQL = f"""SELECT 'd' || substr(work_id, 2) AS work_id, CASE substr(work_id, 2)::BIGINT % 3 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'DBLP' ELSE 'Google Books' END AS source,
  title, authors, year, doi, CASE WHEN substr(work_id, 2)::BIGINT % 3 = 0 THEN 'p' || substr(work_id, 2) END AS pmid FROM {CAT}"""


def _domain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    number = F.substring("work_id", 2, 30).cast("long")
    c = D.catalog(spark, sf).withColumn("n", number)
    source = F.when(F.col("n") % 3 == 0, "PubMed").when(F.col("n") % 3 == 1, "DBLP").otherwise("Google Books")
    works = c.withColumns({"work_id": F.concat(F.lit("d"), F.col("n").cast("string")), "source": source, "pmid": F.when(F.col("n") % 3 == 0, F.concat(F.lit("p"), F.col("n").cast("string")))})
    refs = D.refs(spark, sf).withColumns({"pmid": F.when(F.col("pos") % 6 == 0, F.concat(F.lit("p"), F.col("pos").cast("string"))), "venue": F.when(F.col("pos") % 2 == 0, F.lit("MIT Press, KDD"))})
    return refs, conform(works.drop("n"), CATALOG)


def j6_domain_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by PubMed id and identifier in the sources that references are routed to."""
    refs, works = _domain(spark, sf)
    return M.lookup_domain(refs, works).where("via <> 'title'")


ROUTED = f"""SELECT *, CASE WHEN pos % 6 = 0 THEN 'p' || pos END AS rp, list_filter([CASE WHEN pos % 6 = 0 THEN 'PubMed' END, CASE WHEN arxiv_id IS NOT NULL OR pos % 2 = 0 THEN 'DBLP' END, CASE WHEN pos % 2 = 0 THEN 'Google Books' END], lambda x: x IS NOT NULL) AS ways FROM {REF}"""
DOMAIN_HITS = f"""
WITH r AS ({ROUTED}), d AS ({DOMAIN_SQL}), h AS (
  SELECT ref_id, work_id, source, 'pmid' AS via, ways FROM r JOIN d ON r.rp = d.pmid
  UNION ALL SELECT ref_id, work_id, source, 'doi', ways FROM r JOIN d ON rtrim(lower(r.doi), '/') = lower(d.doi))
SELECT ref_id, work_id, source, max(via) AS via, 1 AS rank FROM h WHERE list_contains(ways, source) GROUP BY 1, 2, 3
"""


def j6_domain_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title search of domain sources: where a reference is routed, PubMed by its first author."""
    refs, works = _domain(spark, sf)
    return M.search_titles(refs.withColumn("_to", M.routed()), works, F.col("_to")).select("ref_id", "work_id", "source", "rank")


SURNAMES = "list_transform({}, lambda x: lower(split_part(x, ',', 1)))"
DOMAIN_TITLES = _title_search_sql(f"({DOMAIN_SQL})", f"({ROUTED})", f"list_contains(ways, s.source) AND (s.source <> 'PubMed' OR list_contains({SURNAMES.format('c.authors')}, {SURNAMES.format('r.authors')}[1]))")


def j5_reopened_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index that is written, opened again by its path and asked by two sets of references."""
    path = shared_path(spark, "titles")
    build_index(D.catalog(spark, sf), path)
    index, core = open_index(spark, path), F.array(*map(F.lit, sources("core")))
    refs = keep(D.refs(spark, sf))
    parts = [search_index(refs.where(F.col("pos") % 2 == k), index, core) for k in (0, 1)]
    out = keep(parts[0].unionByName(parts[1]).select("ref_id", "work_id", "source", "rank"))
    discard(refs, *parts)
    index.drop(spark)
    return out


def j3_stored_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups by identifier and link in tables that are written once and opened again."""
    path, refs, works = shared_path(spark, "keys"), D.refs(spark, sf), D.catalog(spark, sf)
    build_keys(works, path)
    keys = open_keys(spark, path)
    out = keep(M.lookup_doi(refs, works, "core", keys).unionByName(M.lookup_arxiv(refs, works, keys)).unionByName(M.lookup_url(refs, works, keys)))
    keys.drop(spark)
    return out


def m4_m5_c1_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Each work cited under a title that is half its own, by its own and by other authors and years: the
    ratio of titles, the mixed score, and what the check makes of it, its middle band included."""
    works = D.catalog(spark, sf).where("title IS NOT NULL").withColumn("n", F.substring("work_id", 2, 30).cast("long"))
    refs = works.select(
        F.concat(F.lit("r"), "n").alias("ref_id"), F.concat(F.substring_index("title", " ", 5), F.expr("element_at(array(' and other words', ' in short', ' seen from quite another side of it'), cast(n % 3 + 1 AS int))")).alias("title"),
        F.when(F.col("n") % 4 < 3, F.col("authors")).otherwise(F.array(F.lit("Else, X."))).alias("authors"), (F.col("year") + F.col("n") % 2).cast("int").alias("year"), F.when(F.col("n") % 5 > 0, F.lower("venue")).alias("venue"),
    )
    refs = keep(conform(refs, REFS))
    hits = refs.select("ref_id", F.concat(F.lit("w"), F.substring("ref_id", 2, 30)).alias("work_id"), F.lit("Crossref").alias("source"), F.lit("title").alias("via"), F.lit(1).alias("rank"))
    found = C.check_existence(refs, works, M.score_hits(refs, works, hits))
    out = keep(found.select("ref_id", "existence.title_score", "existence.composite", "existence.status", F.round("existence.confidence", 6).alias("confidence")))
    discard(refs)
    return out


# Ratios of a table pairs(t, ct) of lower-case strings. The longest common subsequence goes by rows: a cell is the largest,
# up to it, of the cell above or, where the letters agree, the one before that and one more.
RATIO = """
w AS (SELECT *, list_filter(list_distinct(string_split_regex(t, '\\s+')), lambda z: z <> '') AS x, list_filter(list_distinct(string_split_regex(ct, '\\s+')), lambda z: z <> '') AS y FROM pairs),
j AS (SELECT *, row_number() OVER () AS id, length(array_to_string(list_intersect(x, y), ' ')) AS sect, array_to_string(list_sort(list_filter(x, lambda z: NOT list_contains(y, z))), ' ') AS da, array_to_string(list_sort(list_filter(y, lambda z: NOT list_contains(x, z))), ' ') AS db FROM w),
jj AS MATERIALIZED (SELECT * FROM j),
c AS (SELECT id, string_split(da, '') AS a, string_split(db, '') AS b FROM jj WHERE da <> '' AND db <> ''),
l AS (SELECT id, 0 AS i, list_transform(b, lambda z: 0) AS cells FROM c UNION ALL
  SELECT l.id, i + 1, list_transform(range(1, len(b) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda m: CASE WHEN b[m] = a[i + 1] THEN CASE WHEN m > 1 THEN cells[m - 1] ELSE 0 END + 1 ELSE cells[m] END))) FROM l JOIN c USING (id) WHERE i < len(a)),
lc AS (SELECT jj.*, length(da) AS na, length(db) AS nb, coalesce(cells[-1], 0) AS lcs, CASE WHEN sect > 0 THEN 1 ELSE 0 END AS gap FROM jj LEFT JOIN (SELECT l.* FROM l JOIN c USING (id) WHERE i = len(a)) USING (id)),
ratios AS MATERIALIZED (SELECT t, ct, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE WHEN sect > 0 AND (na = 0 OR nb = 0) THEN 100.0::DOUBLE WHEN sect = 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (na + nb - 2 * lcs) / (2 * gap + na + nb)
  ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (na + nb - 2 * lcs) / (2 * sect + 2 * gap + na + nb), 100.0::DOUBLE - 100.0::DOUBLE * (1 + na) / (2 * sect + gap + na), 100.0::DOUBLE - 100.0::DOUBLE * (1 + nb) / (2 * sect + gap + nb)) END / 100 AS ratio FROM lc),
"""
BANDS = f"""
WITH RECURSIVE p AS (SELECT 'r' || n AS ref_id, lower(array_to_string(string_split(title, ' ')[1:5], ' ') || [' and other words', ' in short', ' seen from quite another side of it'][n % 3 + 1]) AS t, lower(title) AS ct, n, CASE WHEN n % 5 > 0 THEN 1.0 ELSE 0.5 END AS venue
  FROM (SELECT *, {N} AS n FROM {CAT} WHERE length(title) > 0)),
pairs AS (SELECT DISTINCT t, ct FROM p), {RATIO}
q AS (SELECT p.*, ratio AS title FROM p JOIN ratios USING (t, ct)),
s AS (SELECT *, CASE WHEN title = 0 THEN 0.0::DOUBLE ELSE 0.55::DOUBLE * title + 0.25::DOUBLE * CASE WHEN n % 4 < 3 THEN 1 ELSE 0 END + 0.15::DOUBLE * CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END + 0.05::DOUBLE * venue END AS mixed FROM q),
k AS (SELECT *, round(title, 3) >= 0.85 OR mixed * 100 >= 85 AS high, n % 4 = 3 AS bad FROM s)
SELECT ref_id, round(title, 3) AS title_score, round(mixed, 3) AS composite, CASE WHEN high AND bad THEN 'WARN' WHEN high THEN 'PASS' WHEN mixed * 100 >= 70 THEN 'WARN' ELSE 'FAIL' END AS status,
  round(CASE WHEN high AND bad THEN least(greatest(round(title, 3), mixed), 0.85) WHEN high THEN greatest(round(title, 3), mixed) WHEN mixed * 100 >= 70 THEN 0.7 * mixed ELSE 0.7 END, 6)::DOUBLE AS confidence FROM k
"""


def c9_relevance_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts and notes with judgements of the linked pages."""
    reports = verify(D.refs(spark, sf), D.catalog(spark, sf), D.fetch_log(spark, sf), _pages_text(spark, sf), D.answers(spark, sf), Options(check_relevance=True, search=False, domain_mode="none"))
    return reports.select("ref_id", "verdict", F.array_join("notes", " / ").alias("notes"))


RELEVANCE_VERDICTS = f"""
WITH v AS ({VERDICTS}), r AS ({RELEVANCE}), x AS (SELECT v.*, r.status AS rs, label, CASE label WHEN 'UNRELATED' THEN 'Other topic.' WHEN 'PARTIAL' THEN 'Same area.' WHEN 'RELEVANT' THEN 'Same work.' ELSE '' END AS why FROM v LEFT JOIN r USING (ref_id))
SELECT ref_id, CASE WHEN verdict = 'VERIFIED' AND rs = 'FAIL' THEN 'CONTENT_DRIFT' ELSE verdict END AS verdict,
  CASE WHEN verdict <> 'VERIFIED' THEN notes WHEN rs = 'FAIL' THEN 'Content relevance check: ' || label || '. ' || why
    ELSE concat_ws(' / ', nullif(notes, ''), CASE WHEN rs = 'WARN' AND label <> '' THEN 'Relevance check: ' || label || '. ' || why END) END AS notes FROM x
"""


# The whole cascade: hits by identifier, title and link tier by tier, their scores, the best, and what the checks make of it. The works have no domain source.
COUNTS = f"""
WITH RECURSIVE d AS MATERIALIZED ({DOI_HITS}), a AS MATERIALIZED (SELECT * FROM ({ARXIV_HITS}) WHERE ref_id NOT IN (SELECT ref_id FROM d)),
ts AS MATERIALIZED (SELECT * FROM ({TITLE_SEARCH}) WHERE ref_id NOT IN (SELECT ref_id FROM d UNION ALL SELECT ref_id FROM a)),
u AS (SELECT * FROM ({URL_HITS}) WHERE ref_id NOT IN (SELECT ref_id FROM d UNION ALL SELECT ref_id FROM a UNION ALL SELECT ref_id FROM ts)),
h AS (SELECT ref_id, work_id, 1 AS tier, rank FROM d UNION ALL SELECT ref_id, work_id, 2, rank FROM a UNION ALL SELECT ref_id, work_id, 3, rank FROM ts UNION ALL SELECT ref_id, work_id, 5, rank FROM u),
cat AS MATERIALIZED (SELECT * FROM {CAT}), refs AS MATERIALIZED (SELECT * FROM {REF}),
wide AS MATERIALIZED (SELECT h.*, c.source_priority, r.year, c.year AS cy, r.doi, c.doi AS cdoi, lower(nullif(r.title, '')) AS rt, lower(nullif(c.title, '')) AS cti, lower(r.venue) AS rv, lower(c.venue) AS cv,
  coalesce(rtrim(lower(r.doi), '/') = lower(c.doi), false) OR coalesce(r.arxiv_id = c.arxiv_id, false) AS same,
  list_distinct(list_transform(r.authors, lambda z: lower(split_part(z, ',', 1)))) AS a, list_distinct(list_transform(c.authors, lambda z: lower(split_part(z, ',', 1)))) AS b FROM h JOIN refs r USING (ref_id) JOIN cat c USING (work_id)),
pairs AS (SELECT rt AS t, cti AS ct FROM wide WHERE NOT same AND rt IS NOT NULL AND cti IS NOT NULL UNION SELECT rv, cv FROM wide WHERE NOT same AND rv IS NOT NULL AND cv IS NOT NULL), {RATIO}
s AS (SELECT wide.*, {OVERLAP} AS overlap, CASE WHEN same THEN 1.0::DOUBLE ELSE coalesce(x.ratio, 0.0::DOUBLE) END AS title, coalesce(y.ratio, 0.5::DOUBLE) AS venue FROM wide LEFT JOIN ratios x ON x.t = rt AND x.ct = cti LEFT JOIN ratios y ON y.t = rv AND y.ct = cv),
m AS (SELECT *, CASE WHEN same THEN 1.0::DOUBLE WHEN title = 0 THEN 0.0::DOUBLE ELSE 0.55::DOUBLE * title + 0.25::DOUBLE * overlap + 0.15::DOUBLE * CASE abs(year - cy) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END + 0.05::DOUBLE * venue END AS mixed FROM s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY mixed DESC, tier, source_priority, rank, work_id) AS k FROM m) WHERE k = 1),
e AS (SELECT *, round(title, 3) >= 0.85 OR mixed * 100 >= 85 AS high, abs(year - cy) > 2 OR coalesce(trim(lower(doi), '/') <> lower(cdoi), false) OR overlap < 0.3 AS bad FROM best),
f AS (SELECT ref_id, CASE WHEN high AND bad THEN 'BAD' WHEN high THEN 'PASS' WHEN mixed * 100 >= 70 THEN 'WARN' ELSE 'FAIL' END AS found FROM e),
v AS (SELECT CASE WHEN coalesce(found, 'FAIL') = 'FAIL' THEN 'NOT_FOUND' WHEN found = 'BAD' THEN 'METADATA_MISMATCH' WHEN len(coalesce(refs.urls, [])) > 0 AND k.status = 'FAIL' THEN 'DEAD_URL' WHEN g.status = 'FAIL' THEN 'CONTENT_DRIFT' ELSE 'VERIFIED' END AS verdict
  FROM refs LEFT JOIN f USING (ref_id) LEFT JOIN ({URL_AUDIT}) k USING (ref_id) LEFT JOIN ({RELEVANCE}) g USING (ref_id))
SELECT verdict, count(*) AS "references" FROM v GROUP BY 1
"""


def j8_words(spark: SparkSession, sf: str) -> DataFrame:
    """Routing by words of venues: biomedical, computing, both, books and none."""
    venue = F.expr("element_at(array('The Lancet', 'Proc. ICML', 'Brain and KDD', 'Springer', 'Letters'), cast(pos % 5 + 1 AS int))")
    return D.refs(spark, sf).withColumn("venue", venue).select("ref_id", F.array_join(M.routed(), ",").alias("sources"))


ROUTED_WORDS = f"""SELECT ref_id, concat_ws(',', CASE WHEN pos % 5 IN (0, 2) THEN 'PubMed' END, CASE WHEN pos % 5 IN (1, 2) OR arxiv_id IS NOT NULL THEN 'DBLP' END, CASE WHEN pos % 5 = 3 THEN 'Google Books' END) AS sources FROM {REF}"""


# Results of earlier runs: two thirds of the references, then all, then all after failures have expired.
RUNS = (("2024-01-10 00:00:00", "pos % 3 > 0"), ("2024-01-10 12:00:00", "true"), ("2024-01-12 00:00:00", "true"))


def _runs(spark: SparkSession, sf: str, count: int) -> tuple[list[Run], K.Store]:
    store, refs, catalog, log = K.Store(shared_path(spark, "results"), 16), keep(D.refs(spark, sf)), keep(D.catalog(spark, sf)), keep(D.fetch_log(spark, sf))
    done = [verify_incremental(refs.where(which), catalog, store, F.lit(now).cast("timestamp"), log, opts=EXACT) for now, which in RUNS[:count]]
    discard(refs, catalog, log)
    return done, store


def c13_incremental_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What the second run says, two thirds of it from results of the first."""
    runs, store = _runs(spark, sf, 2)
    discard(runs[0].reports)
    delete(spark, store.path)
    return runs[1].reports.select("ref_id", "existence.work_id", F.col("existence.status").alias("existence_status"), "url_liveness.status")


def c13_incremental_work(spark: SparkSession, sf: str) -> DataFrame:
    """How many references and links each run had to work on."""
    runs, store = _runs(spark, sf, len(RUNS))
    discard(*(r.reports for r in runs))
    rows = store.read(spark).agg(F.count("*")).first()[0]
    delete(spark, store.path)
    return spark.createDataFrame([(i + 1, r.references, r.links, rows) for i, r in enumerate(runs)], "run int, references_new long, links_new long, stored long")


# a result is filed under an identity and comes from its first reference
FILED = f"""SELECT *, coalesce(doi, arxiv_id, nullif(title, '') || '|' || year) AS identity, coalesce(coalesce(doi, arxiv_id, nullif(title, '') || '|' || year), ref_id) AS file FROM {REF}"""


def _lead_sql(which: str) -> str:
    return f"SELECT ref_id, file, identity, first_value(ref_id) OVER (PARTITION BY file ORDER BY doc_id, pos, ref_id) AS lead FROM ({FILED}) WHERE {which}"


# the second run has the first run's results, else those of its own first references
INCREMENTAL_REPORTS = f"""
WITH one AS ({_lead_sql(RUNS[0][1])}), two AS ({_lead_sql(RUNS[1][1])}), l AS (SELECT two.ref_id, coalesce(o.lead, two.lead) AS lead FROM two LEFT JOIN (SELECT DISTINCT file, lead FROM one) o USING (file)),
v AS ({VERDICTS}), u AS ({URL_AUDIT})
SELECT l.ref_id, v.work_id, v.existence_status, CASE WHEN u.total_urls > 0 THEN u.status END AS status FROM l JOIN v ON v.ref_id = l.lead JOIN u ON u.ref_id = l.ref_id
"""
INCREMENTAL_WORK = f"""
WITH one AS ({_lead_sql(RUNS[0][1])}), two AS ({_lead_sql(RUNS[1][1])}), v AS ({VERDICTS}), s AS ({URL_STATUS}),
l AS (SELECT DISTINCT two.file, two.identity, coalesce(o.lead, two.lead) AS lead, o.file IS NULL AS late FROM two LEFT JOIN (SELECT DISTINCT file, lead FROM one) o USING (file)),
f AS (SELECT l.*, v.existence_status = 'FAIL' AS failed FROM l JOIN v ON v.ref_id = l.lead),
k AS (SELECT url, status, bool_or(pos % 3 > 0) AS early FROM (SELECT pos, unnest(urls) AS url FROM {REF}) JOIN s USING (url) GROUP BY 1, 2),
n AS (SELECT (SELECT count(*) FROM f WHERE identity IS NOT NULL) + (SELECT count(*) FROM k) AS stored)
SELECT 1::INT AS run, (SELECT count(*) FROM f WHERE NOT late) AS references_new, (SELECT count(*) FROM k WHERE early) AS links_new, stored FROM n
UNION ALL SELECT 2, (SELECT count(*) FROM f WHERE late OR identity IS NULL), (SELECT count(*) FROM k WHERE NOT early), stored FROM n
UNION ALL SELECT 3, (SELECT count(*) FROM f WHERE failed OR identity IS NULL), (SELECT count(*) FROM k WHERE status = 'FAIL'), stored FROM n
"""


def s17_registered_source(spark: SparkSession, sf: str) -> DataFrame:
    """An eighth source, first in ties, with every fifth work: it takes part in tiers, ties and best hits."""
    payload = F.expr("to_json(named_struct('id', work_id, 'title', title, 'doi', doi, 'year', year, 'urls', urls, 'authors', authors))").alias("payload")
    ddl = "id string, title string, doi string, year int, urls array<string>, authors array<string>"

    def mapper(payloads: DataFrame) -> DataFrame:
        p = payloads.select(F.from_json("payload", ddl).alias("p")).select("p.*")
        return G.catalog_rows(p, "Repository", F.col("id"), title=F.col("title"), doi=F.col("doi"), year=F.col("year"), urls=F.col("urls"), authors=F.col("authors"))

    G.register("Repository", mapper, Source(0, "core", ("doi",), "year"))
    try:
        refs, base = keep(D.refs(spark, sf)), keep(D.catalog(spark, sf))
        more = G.union_catalog({"Repository": base.where("substring(work_id, 2, 30) % 5 = 0").select(payload)})
        works = keep(base.unionByName(more))
        hits = M.scored_cascade(refs, works, "none", search=False)
        out = keep(M.best_hits(hits).join(works.select("work_id", "source"), "work_id").select("ref_id", "work_id", "source", "n_candidates"))
        discard(refs, base, works, hits)
    finally:
        G.unregister("Repository")
    return out


REGISTERED = f"""
WITH h AS ({EXACT_HITS}), w AS (SELECT work_id, substr(work_id, 2)::BIGINT % 5 = 0 AS twice FROM {CAT})
SELECT ref_id, CASE WHEN twice AND via <> 'arxiv_id' THEN 'Repository:' || work_id ELSE work_id END AS work_id, CASE WHEN twice AND via <> 'arxiv_id' THEN 'Repository' ELSE source END AS source,
  CASE WHEN twice AND via = 'doi' THEN 2 ELSE 1 END::BIGINT AS n_candidates FROM h JOIN w USING (work_id)
"""


QUERIES = {f.__name__: f for f in (
    verdict_counts, j3_doi_lookup, j4_arxiv_lookup, j7_url_lookup, j9_exact_cascade, j5_title_search, j8_routing, m2_m3_scores, c3_url_status, c5_url_audit, c7_relevance, c9_exact_verdicts,
    c12_enriched, a1_summary_by_document, a4_rate_by_year, s19_markdown, k1_identities, k2_fresh_results, k4_purged_cache, s3_bibtex, s4_ris, s5_csl_json, s6_nbib, s7_doi_list,
    s9_s10_s11_catalog, p19_mined_references, p12_apa_lists, p13_vancouver_lists, p14_lncs_lists, k3_upsert, s16_open_access, p20_recovery_prompts, a3_unparsed, p21_recovered, j6_domain_lookup, w1_best_hits,
    j6_domain_titles, j5_reopened_index, j3_stored_keys, m4_m5_c1_bands, c9_relevance_verdicts, j8_words, c13_incremental_reports, c13_incremental_work, s17_registered_source,
)}

ORACLES = {
    "j3_doi_lookup": DOI_HITS,
    "j4_arxiv_lookup": ARXIV_HITS,
    "j7_url_lookup": URL_HITS,
    "j9_exact_cascade": EXACT_HITS,
    "j5_title_search": TITLE_SEARCH,
    "m2_m3_scores": SCORES,
    "c3_url_status": URL_STATUS,
    "c5_url_audit": URL_AUDIT,
    "c7_relevance": RELEVANCE,
    "c9_exact_verdicts": VERDICTS,
    "c12_enriched": ENRICHED,
    "a1_summary_by_document": f"SELECT doc_id, count(*) AS total, count(*) FILTER (verdict = 'VERIFIED') AS verified, count(*) FILTER (verdict IN ('NOT_FOUND', 'DEAD_URL', 'METADATA_MISMATCH')) AS issues, 0::BIGINT AS skipped, bool_or(verdict IN ('NOT_FOUND', 'DEAD_URL')) AS failed FROM ({VERDICTS}) JOIN (SELECT ref_id, doc_id FROM {REF}) USING (ref_id) GROUP BY 1",
    "a4_rate_by_year": f"SELECT year, count(*) AS total, round(avg((verdict = 'VERIFIED')::INT::DOUBLE), 6) AS verified_share FROM ({VERDICTS}) JOIN (SELECT ref_id, year FROM {REF}) USING (ref_id) GROUP BY 1",
    "k1_identities": IDENTITIES,
    "k2_fresh_results": FRESH,
    "s3_bibtex": BIBTEX,
    "s4_ris": FIELDS_SQL,
    "s5_csl_json": FIELDS_SQL,
    "s6_nbib": FIELDS_SQL,
    "s7_doi_list": f"SELECT doi FROM {CAT} WHERE length(title) > 0",
    "s9_s10_s11_catalog": MAPPED,
    "p19_mined_references": MINED,
    "p12_apa_lists": _styled_sql("Smith, A; Jones, B", "NULL::STRING"),
    "p13_vancouver_lists": _styled_sql("Smith A; Jones B", "NULL::STRING"),
    "p14_lncs_lists": _styled_sql("Smith, A; Jones, B", "venue"),
    "k3_upsert": UPSERT,
    "a3_unparsed": UNPARSED,
    "s16_open_access": OPEN_ACCESS,
    "p20_recovery_prompts": PROMPTS,
    "p21_recovered": RECOVERED,
    "j6_domain_lookup": DOMAIN_HITS,
    "w1_best_hits": BEST_HITS,
    "j6_domain_titles": DOMAIN_TITLES,
    "verdict_counts": COUNTS,
    "j5_reopened_index": TITLE_SEARCH,
    "m4_m5_c1_bands": BANDS,
    "c9_relevance_verdicts": RELEVANCE_VERDICTS,
    "j8_words": ROUTED_WORDS,
    "j3_stored_keys": f"SELECT * FROM ({DOI_HITS}) UNION ALL SELECT * FROM ({ARXIV_HITS}) UNION ALL SELECT * FROM ({URL_HITS})",
    "c13_incremental_reports": INCREMENTAL_REPORTS,
    "c13_incremental_work": INCREMENTAL_WORK,
    "s17_registered_source": REGISTERED,
    "s19_markdown": MARKDOWN,
    "j8_routing": f"SELECT ref_id, CASE WHEN arxiv_id IS NOT NULL THEN 'DBLP' ELSE '' END AS sources FROM {REF}",
    "k4_purged_cache": f"""SELECT status, count(*) AS n, round(sum(confidence), 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY created_at DESC, status DESC, confidence DESC, evidence DESC) AS k FROM {CACHE})
WHERE k = 1 AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(created_at) <= (CASE WHEN status = 'FAIL' THEN 1 ELSE 30 END) * 86400000000 GROUP BY 1""",
}
