"""Checks on a reference and the verdict over them. Every check is one nullable struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..schemas import present
from .matching import best_hits

PASS_TITLE, WARN_TITLE = 85.0, 70.0
# Hosts and phrases of bot protection.
BOT_HOSTS = (
    "linkedin.com", "www.linkedin.com", "twitter.com", "x.com", "www.twitter.com", "facebook.com", "www.facebook.com", "instagram.com", "www.instagram.com",
)
BOT_PHRASES = ("cloudflare", "just a moment", "enable javascript", "checking your browser", "ddos protection", "attention required")
LABELS = {"RELEVANT": "PASS", "PARTIAL": "WARN", "UNRELATED": "FAIL", "CANNOT_DETERMINE": "WARN"}


def check_existence(refs: DataFrame, catalog: DataFrame, scored: DataFrame) -> DataFrame:
    """(ref_id, existence, best) for every reference, from scored hits."""
    best = best_hits(scored)
    found = catalog.select("work_id", F.struct("title", "authors", "year", "venue", "doi", "arxiv_id", "abstract").alias("best"))
    r = refs.select("ref_id", F.struct("title", "authors", "year", "venue", "doi", "arxiv_id").alias("r"))
    rows = r.join(best, "ref_id", "left").join(found, "work_id", "left")
    top = F.greatest("title_score", "composite")
    high = (F.col("title_score") >= PASS_TITLE / 100) | (F.col("composite") * 100 >= PASS_TITLE)
    mid = F.col("composite") * 100 >= WARN_TITLE
    none = F.col("work_id").isNull()
    rows = rows.withColumn("mismatches", F.when(~none & high, S.mismatches("r", "best")).otherwise(F.array().cast("array<string>")))
    bad = F.size("mismatches") > 0
    status = F.when(none, "FAIL").when(high & bad, "WARN").when(high, "PASS").when(mid, "WARN").otherwise("FAIL")
    named = present(F.col("r.title")).isNotNull() | present(F.col("r.doi")).isNotNull()
    confidence = (
        F.when(none & named, F.lit(0.9)).when(none, F.lit(0.5)).when(high & bad, F.least(top, F.lit(0.85))).when(high, top).when(mid, 0.7 * F.col("composite")).otherwise(F.lit(0.7))
    )
    check = F.struct(
        status.alias("status"), confidence.alias("confidence"), "work_id", "title_score", F.round("composite", 3).alias("composite"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "mismatches"
    )
    return rows.select("ref_id", check.alias("existence"), "best")


def url_status(log: DataFrame) -> DataFrame:
    """(url, result) per fetched link; of repeated rows one."""
    body = F.lower(F.substring(F.coalesce("body", F.lit("")), 1, 2000))
    bot = X.host(F.coalesce("final_url", "url")).isin(*BOT_HOSTS) | ((F.col("status_code") == 403) & body.rlike("|".join(BOT_PHRASES)))
    ok = F.col("status_code").between(200, 299)
    kind = F.col("error_kind")
    status = F.when(kind == "timeout", "WARN").when(kind.isNotNull(), "FAIL").when(bot, "SKIPPED").when(ok, "PASS").otherwise("FAIL")
    error = F.when(kind == "timeout", F.lit("timeout")).when(kind.isNotNull(), F.col("error")).when(~F.coalesce(bot | ok, F.lit(False)), F.format_string("HTTP %d", "status_code"))
    result = F.struct(
        status.alias("status"), "status_code", "final_url", F.when(kind.isNull(), F.col("final_url") != F.col("url")).alias("redirected"), F.when(kind.isNull(), bot).alias("bot_protection"), error.alias("error")
    )
    return log.where("url IS NOT NULL").select("url", result.alias("result")).groupBy("url").agg(F.min("result").alias("result"))


def check_urls(refs: DataFrame, statuses: DataFrame) -> DataFrame:
    """(ref_id, url_liveness). Links are fetched once each, so the join is many to one;
    links without a result count as timeouts."""
    cited = refs.select("ref_id", F.posexplode("urls").alias("pos", "url"))
    seen = cited.join(statuses, "url", "left").withColumn("status", F.coalesce("result.status", F.lit("WARN")))
    each = F.struct("pos", "url", "status", F.col("result.status_code").alias("status_code"), F.col("result.redirected").alias("redirected"), F.col("result.error").alias("error"))
    rolled = seen.groupBy("ref_id").agg(
        F.bool_or(F.col("status") == "FAIL").alias("fail"), F.bool_or(F.col("status") == "WARN").alias("warn"), F.bool_and(F.col("status") == "SKIPPED").alias("skip"),
        F.array_sort(F.collect_list(each)).alias("results"),
    )
    status = F.when(F.col("fail"), "FAIL").when(F.col("warn"), "WARN").when(F.col("skip"), "SKIPPED").otherwise("PASS")
    confidence = F.when(F.col("fail"), 0.9).when(F.col("warn"), 0.7).when(F.col("skip"), 0.5).otherwise(0.95)
    check = F.struct(status.alias("status"), confidence.alias("confidence"), "results", F.size("results").alias("total_urls"))
    without = F.struct(F.lit("SKIPPED").alias("status"), F.lit(1.0).alias("confidence"), F.lit(None).alias("results"), F.lit(0).alias("total_urls"))
    return refs.select("ref_id").join(rolled.select("ref_id", check.alias("u")), "ref_id", "left").select("ref_id", F.coalesce("u", without).alias("url_liveness"))


JUDGE_PROMPT = (
    "Judge whether the content below is what the reference cites.\n\nTitle: %s\nContext: %s\n\nContent (first 1500 characters):\n%s\n\n"
    'Answer with JSON only: {"label": "RELEVANT|PARTIAL|UNRELATED|CANNOT_DETERMINE", "confidence": 0.0-1.0, "rationale": "one sentence"}'
)


def relevance_inputs(refs: DataFrame, pages: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    """(ref_id, content, content_source, prompt, prompt_tokens, reason). ``abstracts``:
    (ref_id, abstract) of best candidates; else the text of the first link's page."""
    text = F.substring(X.strip(F.regexp_replace(F.substring("text", 1, 3000), r"(?U)\s+", " ")), 1, 1500)
    fetched = pages.where(F.col("status_code").between(200, 299)).groupBy(F.col("url").alias("first_url")).agg(F.min(text).alias("page"))
    rows = refs.withColumn("first_url", F.get("urls", F.lit(0))).join(fetched, "first_url", "left")
    rows = rows.join(abstracts.select("ref_id", "abstract"), "ref_id", "left") if abstracts is not None else rows.withColumn("abstract", F.lit(None).cast("string"))
    content = F.coalesce(present(F.col("abstract")), present(F.col("page")))
    context = F.concat(
        F.coalesce(F.concat(F.lit("Published in: "), present(F.col("venue")), F.lit(". ")), F.lit("")), F.coalesce(F.concat(F.lit("Year: "), F.when(F.col("year") != 0, F.col("year")).cast("string"), F.lit(".")), F.lit(""))
    )
    reason = F.when(present(F.col("title")).isNull() & present(F.col("doi")).isNull(), "insufficient_reference_data").when(content.isNull(), "no_content_available")
    prompt = F.when(reason.isNull(), F.format_string(JUDGE_PROMPT, F.coalesce(present(F.col("title")), F.lit("Unknown title")), context, content))
    out = rows.select("ref_id", content.alias("content"), F.when(present(F.col("abstract")).isNotNull(), "abstract").otherwise("fetched").alias("content_source"), prompt.alias("prompt"), reason.alias("reason"))
    return out.withColumn("prompt_tokens", F.size(F.filter(F.split("prompt", r"\s+"), lambda x: x != "")))


def check_relevance(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """(ref_id, relevance) from answers (ref_id, response, error); a reference without an
    answer has no check unless its inputs already decide it."""
    given = answers.groupBy("ref_id").agg(F.min(F.struct("response", "error")).alias("g"))
    rows = inputs.join(given, "ref_id", "left").select("ref_id", "reason", "g.response", "g.error")
    text = X.strip(F.col("response"))
    text = F.when(text.startswith("```"), X.strip(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("```")), "\n"))).otherwise(text)
    data = F.from_json(text, "label string, confidence string, rationale string")
    rows = rows.withColumn("valid", F.try_parse_json(text)).withColumn("d", data)
    label = F.coalesce("d.label", F.lit("CANNOT_DETERMINE"))
    confidence = F.coalesce("d.confidence", F.lit("0.3")).try_cast("double")
    is_object = text.startswith("{")
    failed = F.col("error").isNotNull() | (F.col("valid").isNotNull() & ~is_object)
    broken = F.col("valid").isNull() | ~label.isin(*LABELS) | confidence.isNull()
    decided = F.when(F.col("reason") == "insufficient_reference_data", "SKIPPED").when(F.col("reason").isNotNull(), "WARN")
    status = F.coalesce(decided, F.when(failed | broken, "WARN").otherwise(F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in LABELS.items()))))
    sure = F.when(F.col("reason") == "insufficient_reference_data", 0.0).when(F.col("reason").isNotNull(), 0.3).when(failed, 0.1).when(broken, 0.2).otherwise(confidence)
    told = F.when(F.col("reason") == "no_content_available", "CANNOT_DETERMINE").when(F.col("reason").isNotNull() | failed | broken, F.lit(None)).otherwise(label)
    check = F.struct(
        status.alias("status"), sure.alias("confidence"), told.alias("label"), F.when(told.isNotNull(), F.coalesce(F.when(F.col("reason").isNull(), F.col("d.rationale")), F.lit(""))).alias("rationale"),
        F.coalesce(F.col("reason").isNull() & ~failed & broken, F.lit(False)).alias("parse_error"),
    )
    known = F.col("reason").isNotNull() | F.col("response").isNotNull() | F.col("error").isNotNull()
    return rows.where(known).select("ref_id", check.alias("relevance"))


# The wording of notes.
NOTES = {
    "unparsed": "Reference could not be parsed into checkable fields.",
    "not_run": "Existence check could not run.",
    "not_found": "Could not verify this reference in any scholarly database. It may be fabricated, obscure, or not yet indexed. Manual review recommended.",
    "also_dead": "Additionally, one or more cited URLs are not reachable.",
    "dead": "One or more cited URLs returned an error status (4xx/5xx).",
    "slow": "Some URLs timed out or had inconclusive responses.",
}


def with_verdict(rows: DataFrame) -> DataFrame:
    """``verdict`` and ``notes`` from the check structs of each row."""
    e, u, r = F.col("existence"), F.col("url_liveness"), F.col("relevance")
    empty = present(F.col("title")).isNull() & present(F.col("doi")).isNull() & (F.size("authors") == 0) & present(F.col("arxiv_id")).isNull()
    not_run = e.isNull() | (e["status"] == "ERROR")
    bad = (e["status"] == "WARN") & (F.size(e["mismatches"]) > 0)
    dead, drift = F.coalesce(u["status"] == "FAIL", F.lit(False)), F.coalesce(r["status"] == "FAIL", F.lit(False))
    verdict = (
        F.when(empty | not_run, "UNRESOLVABLE").when(e["status"] == "FAIL", "NOT_FOUND").when(bad, "METADATA_MISMATCH").when(dead, "DEAD_URL").when(drift, "CONTENT_DRIFT").otherwise("VERIFIED")
    )
    said = lambda prefix: F.concat(F.lit(prefix), r["label"], F.lit(". "), F.coalesce(r["rationale"], F.lit("")))
    lit = lambda k: F.lit(NOTES[k])
    some = lambda *c: F.array_compact(F.array(*c))
    notes = (
        F.when(empty, some(lit("unparsed")))
        .when(not_run, some(lit("not_run")))
        .when(e["status"] == "FAIL", some(lit("not_found")))
        .when(bad, some(F.concat(F.lit("Metadata mismatches found: "), F.array_join(e["mismatches"], "; ")), F.when(dead, lit("also_dead"))))
        .when(dead, some(lit("dead")))
        .when(drift, some(said("Content relevance check: ")))
        .otherwise(some(F.when(u["status"] == "WARN", lit("slow")), F.when((r["status"] == "WARN") & (F.length(r["label"]) > 0), said("Relevance check: "))))
    )
    return rows.withColumn("verdict", verdict).withColumn("notes", notes)


def shown(verdict: Column) -> Column:
    """C11: how a verdict is worded."""
    return F.when(verdict == "NOT_FOUND", F.lit("could not verify — likely fabricated, needs manual review")).otherwise(verdict)


def enriched(best: Column) -> Column:
    """The reference with gaps filled from the best candidate, null where nothing is."""
    year = F.when(F.col("year") != 0, F.col("year"))
    lacks = year.isNull() | present(F.col("doi")).isNull() | present(F.col("venue")).isNull()
    offers = F.coalesce(F.when(best["year"] != 0, F.lit(1)), F.when(present(best["doi"]).isNotNull(), F.lit(1)), F.when(present(best["venue"]).isNotNull(), F.lit(1))).isNotNull()
    fill = lambda n: F.coalesce(present(F.col(n)), best[n]).alias(n)
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce(best["authors"], F.array().cast("array<string>")))
    return F.when(lacks & offers, F.struct(fill("title"), authors.alias("authors"), F.coalesce(year, best["year"]).alias("year"), fill("venue"), fill("doi")))
