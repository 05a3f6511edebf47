"""Similarity and scores of a cited work against a found one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import present
from .text import arxiv_key, strip

TITLE_WEIGHT, AUTHOR_WEIGHT, YEAR_WEIGHT, VENUE_WEIGHT, UNKNOWN = 0.55, 0.25, 0.15, 0.05, 0.5


def surname(name: Column) -> Column:
    """M1: before the comma, else the last word."""
    n = strip(name)
    return F.lower(F.when(n.contains(","), strip(F.substring_index(n, ",", 1))).otherwise(F.element_at(F.split(n, r"(?U)\s+"), -1)))


def author_overlap(cited: Column, found: Column) -> Column:
    """M2: of surname sets; recall where the cited list is less than half as long."""
    a, b = (F.array_distinct(F.transform(x, surname)) for x in (cited, found))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(cited) == 0) | (F.size(found) == 0), F.lit(UNKNOWN))
        .when(F.size(a) < F.size(b) * 0.5, both / F.size(a))
        .otherwise(both / F.size(F.array_union(a, b)))
    )


def year_score(cited: Column, found: Column) -> Column:
    """M3."""
    gap = F.abs(cited - found)
    return F.when(gap.isNull(), F.lit(UNKNOWN)).when(gap == 0, F.lit(1.0)).when(gap == 1, F.lit(0.7)).otherwise(F.lit(0.0))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine word of Python's integers per row of bits."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_of(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], int] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if (n := memo.get((x, y))) is None:
            n = memo[x, y] = lcs_length(x, y)
        out.append(n)
    return pd.Series(out, dtype="Int32")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != ""))


def _joined(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def _lcs(da: Column, db: Column) -> Column:
    """Only pairs with words on both sides that the other lacks need the subsequence."""
    need = (F.length(da) > 0) & (F.length(db) > 0)
    return lcs_of(F.when(need, da), F.when(need, db))


def _ratio(x: Column, y: Column, sect: Column, da: Column, db: Column, lcs: Column) -> Column:
    """Of word sets, the length of what they share, and what each has alone, joined."""
    na, nb = F.length(da), F.length(db)
    gap = F.when(sect > 0, 1).otherwise(0)
    la, lb = sect + gap + na, sect + gap + nb
    r1 = 100 - 100 * (na + nb - 2 * lcs) / (la + lb)
    r2 = 100 - 100 * (1 + na) / (sect + la)
    r3 = 100 - 100 * (1 + nb) / (sect + lb)
    value = (
        F.when((F.size(x) <= 0) | (F.size(y) <= 0), F.lit(0.0))
        .when((sect > 0) & ((na == 0) | (nb == 0)), F.lit(100.0))
        .when(sect == 0, r1)
        .otherwise(F.greatest(r1, r2, r3))
    )
    return F.coalesce(value, F.lit(0.0)) / 100.0


def token_set_ratio(a: Column, b: Column) -> Column:
    """M4: 0 to 1. Sets of words and the length bound are built-in."""
    x, y = _words(a), _words(b)
    da, db = _joined(F.array_except(x, y)), _joined(F.array_except(y, x))
    return _ratio(x, y, F.length(_joined(F.array_intersect(x, y))), da, db, _lcs(da, db))


def with_ratio(rows: DataFrame, name: str, a: Column, b: Column) -> DataFrame:
    """M4 as a column ``name``, step by step, so that no step's expression is repeated in the next."""
    part = lambda p: F.col(f"_{name}_{p}")
    put = lambda t, **columns: t.withColumns({f"_{name}_{p}": c for p, c in columns.items()})
    rows = put(rows, x=_words(a), y=_words(b))
    x, y, da, db = map(part, ("x", "y", "da", "db"))
    rows = put(rows, both=F.length(_joined(F.array_intersect(x, y))), da=_joined(F.array_except(x, y)), db=_joined(F.array_except(y, x)))
    rows = put(rows, lcs=_lcs(da, db)).withColumn(name, _ratio(x, y, part("both"), da, db, part("lcs")))
    return rows.drop(*(f"_{name}_{p}" for p in ("x", "y", "both", "da", "db", "lcs")))


def with_scores(rows: DataFrame, r: str, c: str, any_version: bool = False) -> DataFrame:
    """M5: rows with ``title_score`` and ``composite`` of struct columns r (cited) and c (found).
    ``any_version``: arXiv ids are the same without their versions, else with them."""
    f = lambda s, n: F.col(f"{s}.{n}")
    same_arxiv = (arxiv_key if any_version else present)(f(r, "arxiv_id")) == (arxiv_key if any_version else present)(f(c, "arxiv_id"))
    same_doi = F.rtrim(F.lower(present(f(r, "doi"))), F.lit("/")) == F.rtrim(F.lower(present(f(c, "doi"))), F.lit("/"))
    same = F.col("_same")
    known = present(f(r, "title")).isNotNull() & present(f(c, "title")).isNotNull() & ~same
    venues = present(f(r, "venue")).isNotNull() & present(f(c, "venue")).isNotNull() & ~same
    rows = rows.withColumn("_same", F.coalesce(same_arxiv, F.lit(False)) | F.coalesce(same_doi, F.lit(False)))
    rows = with_ratio(rows, "_title", F.when(known, f(r, "title")), F.when(known, f(c, "title")))
    rows = with_ratio(rows, "_venue", F.when(venues, f(r, "venue")), F.when(venues, f(c, "venue")))
    rows = rows.withColumns({"_title": F.when(same, F.lit(1.0)).otherwise(F.col("_title")), "_venue": F.when(venues, F.col("_venue")).otherwise(F.lit(UNKNOWN)), "_who": author_overlap(f(r, "authors"), f(c, "authors"))})
    mixed = TITLE_WEIGHT * F.col("_title") + AUTHOR_WEIGHT * F.col("_who") + YEAR_WEIGHT * year_score(f(r, "year"), f(c, "year")) + VENUE_WEIGHT * F.col("_venue")
    done = rows.withColumns({"title_score": F.round("_title", 3), "composite": F.when(same, F.lit(1.0)).when(F.col("_title") == 0, F.lit(0.0)).otherwise(mixed)})
    return done.drop("_same", "_title", "_venue", "_who")


def mismatches(r: str, c: str) -> Column:
    """M6: messages on year, identifier and authors."""
    f = lambda s, n: F.col(f"{s}.{n}")
    trim = lambda x: F.trim(F.lower(x), F.lit("/"))
    overlap = author_overlap(f(r, "authors"), f(c, "authors"))
    two = lambda x: F.concat(F.lit("['"), F.array_join(F.slice(x, 1, 2), "', '"), F.lit("']"))
    year = F.when((f(r, "year") > 0) & (f(c, "year") > 0) & (F.abs(f(r, "year") - f(c, "year")) > 2), F.format_string("year: cited=%d, found=%d", f(r, "year"), f(c, "year")))
    doi = F.when(trim(present(f(r, "doi"))) != trim(present(f(c, "doi"))), F.format_string("doi: cited=%s, found=%s", f(r, "doi"), f(c, "doi")))
    both = (F.size(f(r, "authors")) > 0) & (F.size(f(c, "authors")) > 0)
    who = F.when(both & (overlap < 0.3), F.format_string("authors: low overlap (%.2f), cited=%s, found=%s", overlap, two(f(r, "authors")), two(f(c, "authors"))))
    return F.array_compact(F.array(year, doi, who))
