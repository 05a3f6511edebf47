"""Verification of a table of references end to end, whole or on top of stored results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cache as K
from ..operators import checks as C
from ..operators.key_index import KeyIndex
from ..operators.matching import scored_cascade
from ..operators.title_index import TitleIndex
from ..storage import discard, keep

EXISTENCE = (
    "struct<status: string, confidence: double, work_id: string, title_score: double, composite: double, n_candidates: bigint, mismatches: array<string>>"
)
BEST = "struct<title: string, authors: array<string>, year: int, venue: string, doi: string, arxiv_id: string, abstract: string>"
URL_RESULT = "struct<status: string, status_code: int, final_url: string, redirected: boolean, bot_protection: boolean, error: string>"
RELEVANCE = "struct<status: string, confidence: double, label: string, rationale: string, parse_error: boolean>"


@dataclass(frozen=True)
class Options:
    """What to run: link and relevance checks, title search, domain sources."""

    check_url: bool = True
    check_relevance: bool = False
    search: bool = True
    domain_mode: str = "auto"


def _existence(refs: DataFrame, catalog: DataFrame, opts: Options, index: TitleIndex | None, keys: KeyIndex | None) -> DataFrame:
    """(ref_id, existence, best), kept."""
    scored = scored_cascade(refs, catalog, opts.domain_mode, opts.search, index, keys)
    out = keep(C.check_existence(refs, catalog, scored))
    discard(scored)
    return out


def _reports(refs: DataFrame, existence: DataFrame, urls: DataFrame | None, relevance: DataFrame | None) -> DataFrame:
    """C8-C12 over the checks, kept. A reference that is not found and has no links gets no further
    checks."""
    rows = refs.join(existence, "ref_id").withColumn("_on", ~((F.col("existence.status") == "FAIL") & (F.size("urls") == 0)))
    if urls is not None:
        rows = rows.join(urls.withColumnRenamed("url_liveness", "_u"), "ref_id", "left").withColumn("url_liveness", F.when(F.col("_on") & (F.size("urls") > 0), F.col("_u"))).drop("_u")
    else:
        rows = rows.withColumn("url_liveness", F.lit(None).cast("struct<status: string, confidence: double>"))
    if relevance is not None:
        rows = rows.join(relevance.withColumnRenamed("relevance", "_r"), "ref_id", "left").withColumn("relevance", F.when(F.col("_on"), F.col("_r"))).drop("_r")
    else:
        rows = rows.withColumn("relevance", F.lit(None).cast("struct<status: string, confidence: double, label: string, rationale: string>"))
    done = C.with_verdict(rows)
    return keep(done.withColumn("enriched", F.when(F.col("_on"), C.enriched(F.col("best")))).drop("_on", "best"))


def verify(refs: DataFrame, catalog: DataFrame, fetch_log: DataFrame | None = None, pages: DataFrame | None = None, answers: DataFrame | None = None, opts: Options = Options(), index: TitleIndex | None = None, keys: KeyIndex | None = None) -> DataFrame:
    """One report per reference, in (doc_id, pos) terms; order only at the sink. ``index`` and
    ``keys`` are stored tables of the catalog; without an index one is made and goes again. The reports are
    kept; what they were made of is deleted."""
    refs, catalog = keep(refs), keep(catalog)
    existence = _existence(refs, catalog, opts, index, keys)
    urls = C.check_urls(refs, C.url_status(fetch_log)) if opts.check_url and fetch_log is not None else None
    relevance = inputs = None
    if opts.check_relevance and pages is not None and answers is not None:
        inputs = keep(C.relevance_inputs(refs, pages, existence.select("ref_id", "best.abstract")))
        relevance = C.check_relevance(inputs, answers)
    out = _reports(refs, existence, urls, relevance)
    discard(refs, catalog, existence, *([inputs] if inputs is not None else []))
    return out


def _result(evidence: Column, ddl: str) -> Column:
    return F.from_json(evidence, T.StructType.fromDDL(f"r {ddl}"))["r"]


def _filed(rows: DataFrame, namespace: str, identifier: Column) -> DataFrame:
    """Rows with the key that their result is filed under, null where it is not."""
    return rows.withColumn("_id", identifier).withColumn("_key", K.key(F.lit(namespace), F.col("_id")))


def _entry(namespace: str, check: str, evidence: Column, now: Column) -> list[Column]:
    of = lambda n: F.col(f"{check}.{n}")
    sure = of("confidence") if check != "result" else F.lit(None).cast("double")
    return [F.lit(namespace).alias("namespace"), F.col("_id").alias("identifier"), F.col("_key").alias("key"), of("status").alias("status"), sure.alias("confidence"), evidence.alias("evidence"), now.alias("created_at")]


@dataclass(frozen=True)
class Run:
    """What an incremental run did: its reports, and how many references, links and answers were
    worked on anew. ``drop`` deletes the reports."""

    reports: DataFrame
    references: int
    links: int
    answers: int
    slices: int


def verify_incremental(
    refs: DataFrame, catalog: DataFrame, store: K.Store, now: Column, fetch_log: DataFrame | None = None, pages: DataFrame | None = None, answers: DataFrame | None = None, opts: Options = Options(), index: TitleIndex | None = None, keys: KeyIndex | None = None
) -> Run:
    """C13 over K1-K4: results in the store that are still fresh are taken as they are; only what is
    left is looked up, scored and judged, once for each identity, and goes into the store.

    References with the same identity share one result: that of the first in (doc_id, pos) order,
    as it would be if they came one after the other. Those without an identity are always
    worked on and never stored; nor are judgements that needed no answer. Only slices of the store
    with a changed key are written again.
    """
    refs, catalog = keep(refs), keep(catalog)
    spark = refs.sparkSession
    filed = keep(_filed(refs, "existence", K.identity("existence")).select("ref_id", "doc_id", "pos", "_id", "_key"))
    hit, miss = store.lookup(filed.select("ref_id", "doc_id", "pos", "_id", F.col("_key").alias("key")), now)
    hit = keep(hit.select("ref_id", _result("evidence", f"struct<existence: {EXISTENCE}, best: {BEST}>").alias("r")))
    # of equal identities the first one is worked on
    first = miss.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "pos", "ref_id")).alias("m")).select("key", F.col("m.ref_id").alias("lead"))
    follow = keep(miss.join(first, "key", "left").select("ref_id", F.coalesce("lead", "ref_id").alias("lead"), "_id", F.col("key").alias("_key")))
    todo = keep(refs.join(follow.where("ref_id = lead").select("ref_id"), "ref_id", "left_semi"))
    new = _existence(todo, catalog, opts, index, keys) if (references := todo.count()) else spark.createDataFrame([], T.StructType.fromDDL(f"ref_id string, existence {EXISTENCE}, best {BEST}"))
    shared = follow.join(new.withColumnRenamed("ref_id", "lead"), "lead").select("ref_id", "existence", "best")
    existence = keep(hit.select("ref_id", "r.existence", "r.best").unionByName(shared))
    entries = [follow.where("ref_id = lead AND _key IS NOT NULL").join(new, "ref_id").select(*_entry("existence", "existence", F.to_json(F.struct(F.struct("existence", "best").alias("r"))), now))]

    urls, links, temporary = None, 0, []
    if opts.check_url and fetch_log is not None:
        cited = refs.select(F.explode("urls").alias("url")).distinct()
        known, unknown = store.lookup(_filed(cited, "url_liveness", K.identity("url_liveness")).withColumnRenamed("_key", "key"), now)
        fetched = keep(C.url_status(fetch_log.join(unknown.select("url").distinct(), "url", "left_semi")))
        links = fetched.count()
        temporary.append(fetched)
        urls = C.check_urls(refs, known.select("url", _result("evidence", URL_RESULT).alias("result")).unionByName(fetched.select("url", F.col("result").cast(URL_RESULT).alias("result"))))
        entries.append(_filed(fetched, "url_liveness", K.identity("url_liveness")).select(*_entry("url_liveness", "result", F.to_json(F.struct(F.col("result").alias("r"))), now)))

    relevance, judged = None, 0
    if opts.check_relevance and pages is not None and answers is not None:
        asks = _filed(refs.where("title IS NOT NULL OR doi IS NOT NULL"), "relevance", K.identity("relevance"))
        known, unknown = store.lookup(asks.select("ref_id", "doc_id", "pos", "_id", F.col("_key").alias("key")), now)
        known = keep(known.select("ref_id", _result("evidence", RELEVANCE).alias("relevance")))
        rest = refs.join(known.select("ref_id"), "ref_id", "left_anti")
        inputs = keep(C.relevance_inputs(rest, pages, existence.select("ref_id", "best.abstract")))
        found = keep(C.check_relevance(inputs, answers).select("ref_id", F.col("relevance").cast(RELEVANCE).alias("relevance")))
        stored = unknown.where("key IS NOT NULL").join(inputs.where("reason IS NULL").select("ref_id"), "ref_id").join(found, "ref_id")
        judged = stored.count()
        newest = keep(stored.groupBy("key").agg(F.min(F.struct("doc_id", "pos", "ref_id", "_id", "relevance")).alias("m")).select("m.*", F.col("key").alias("_key")))
        # later references of the same identity take the first judgement
        place = lambda *names: F.struct(*(F.col(n).alias(str(i)) for i, n in enumerate(names)))
        after = unknown.join(newest.select(F.col("_key").alias("key"), place("doc_id", "pos", "ref_id").alias("_first"), F.col("relevance").alias("_shared")), "key").where(place("doc_id", "pos", "ref_id") > F.col("_first"))
        both = found.join(after.select("ref_id", "_shared"), "ref_id", "full").select("ref_id", F.coalesce("_shared", "relevance").alias("relevance"))
        relevance = keep(known.unionByName(both))
        temporary += [known, inputs, found, newest, relevance]
        entries.append(newest.select(*_entry("relevance", "relevance", F.to_json(F.struct(F.col("relevance").alias("r"))), now)))

    reports = _reports(refs, existence, urls, relevance)
    made = entries[0]
    for e in entries[1:]:
        made = made.unionByName(e)
    slices = store.merge(made)
    discard(refs, catalog, filed, hit, follow, todo, new, existence, *temporary)
    return Run(reports, references, links, judged, slices)
