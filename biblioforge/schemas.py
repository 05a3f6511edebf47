"""Column sets of the tables that the library works on.

Empty strings count as missing and become null once, at ingestion; authors and urls are
empty arrays, never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFS = (
    "ref_id string, doc_id string, pos int, raw string, title string, authors array<string>, year int, venue string, "
    "doi string, arxiv_id string, urls array<string>, pmid string"
)
CATALOG = (
    "work_id string, source string, source_priority int, title string, authors array<string>, year int, venue string, "
    "doi string, arxiv_id string, pmid string, isbn string, urls array<string>, abstract string"
)
FETCH_LOG = "url string, status_code int, final_url string, body string, error_kind string, error string"
PAGES_TEXT = "url string, status_code int, text string"
MODEL_ANSWERS = "ref_id string, response string, error string"
CHECK_CACHE = "namespace string, identifier string, key string, status string, confidence double, evidence string, created_at timestamp"


@dataclass(frozen=True)
class Source:
    """What matching knows of a source: its place in ties (smaller wins), the tier that asks it, by
    which identifiers it is found, what else than the title its search compares (year,
    first_author or nothing), and words of venue or text that lead to a domain source."""

    priority: int
    tier: str = "core"
    ids: tuple[str, ...] = ("doi",)
    search_filter: str | None = None
    words: tuple[str, ...] = ()


#: The sources, in fixed order; ``register`` of sources.catalog adds to them.
REGISTRY: dict[str, Source] = {
    "Crossref": Source(1), "OpenAlex": Source(2, search_filter="year"), "Semantic Scholar": Source(3, ids=("doi", "arxiv_id")), "arXiv": Source(4, ids=("doi", "arxiv_id", "arxiv_doi")),
    "PubMed": Source(5, "domain", ("doi", "pmid"), "first_author"), "DBLP": Source(6, "domain"), "Google Books": Source(7, "domain"),
}


def sources(tier: str | None = None, by: str | None = None) -> list[str]:
    """Names of sources of a tier or with a kind of identifier, first ones first."""
    found = [(r.priority, s) for s, r in REGISTRY.items() if tier in (None, r.tier) and (by is None or by in r.ids)]
    return [s for _, s in sorted(found)]


def present(c: Column) -> Column:
    """Null for a missing or empty string."""
    return F.when(F.length(c) > 0, c)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The table with exactly the schema's columns: missing ones null, empty strings null,
    null arrays empty."""
    out = []
    for f in T.StructType.fromDDL(ddl).fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            c = present(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def priority(source: Column) -> Column:
    """A source's place in ties; sources that nobody registered come last."""
    out = F.lit(2**31 - 1)
    for name, r in REGISTRY.items():
        out = F.when(source == name, F.lit(r.priority)).otherwise(out)
    return out.cast("int")
