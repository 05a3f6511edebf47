"""Column functions on citation text: identifiers, years, author lists, cleaning.

Patterns are Java's; ``(?U)`` where letters beyond ASCII count. Each function is one
expression, so whole-stage code generation covers them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import present

# Patterns that decide what is found in citation text.
DOI = r"10\.\d{4,}/\S+"
DOI_IN_URL = r"\b(10\.\d{4,}/[^\s\"<>\]{}\\^`|]+)"
URL = r"https?://[^\s,;>\"')]+"
YEAR = r"\b(?:19|20)\d{2}\b"
ARXIV_URL = r"arxiv\.org/abs/([^\s/,;]+)"
ARXIV_TAG = r"(?i)\barXiv:\s*(\d{4}\.\d+)"
ARXIV_BROKEN = r"(?i)arxiv[.\s]+org/abs/([^\s,;)]+)"
MARKER = r"[^\S\n]*(?:\[?\d{1,3}\]?\.?\)?[^\S\n]+|[¹²³⁴⁵⁶⁷⁸⁹⁰]+[^\S\n]+)"
TRAIL = ".,;)"


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null without one."""
    return present(F.regexp_extract(c, pattern, n))


def strip(c: Column) -> Column:
    """Trim all white space, not blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def unhyphenate(c: Column) -> Column:
    """Rejoin words broken over lines."""
    return F.regexp_replace(c, r"(?U)(\w)-\n\s*(\w)", "$1$2")


def unmark_headings(c: Column) -> Column:
    """Drop Markdown heading markers."""
    return F.regexp_replace(c, r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", "")


def clean_chunk(c: Column) -> Column:
    """One line, without its number."""
    line = strip(F.regexp_replace(unhyphenate(c), r"(?U)\s+", " "))
    return strip(F.regexp_replace(line, "^" + MARKER, ""))


def find_doi(c: Column) -> Column:
    """P7."""
    return present(rstrip(F.regexp_substr(c, F.lit(DOI)), TRAIL))


def find_urls(c: Column) -> Column:
    """No resolver links, no links without a path."""
    found = F.transform(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), lambda u: rstrip(u, TRAIL + ">\"'"))
    path = lambda u: F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.filter(found, lambda u: ~u.contains("doi.org") & (rstrip(path(u), "/") != "")), F.array().cast("array<string>"))


def find_arxiv(text: Column, urls: Column) -> Column:
    """From links, then the text, then a tag, then a broken link."""
    in_urls = F.get(F.filter(F.transform(urls, lambda u: F.regexp_extract(u, ARXIV_URL, 1)), lambda x: x != ""), F.lit(0))
    return F.coalesce(in_urls, group(text, ARXIV_URL), group(text, ARXIV_TAG), strip(group(text, ARXIV_BROKEN)))


def find_year(c: Column) -> Column:
    """P10: the first standalone year."""
    return F.regexp_substr(c, F.lit(r"(?U)" + YEAR)).try_cast("int")


def author_list(c: Column, most: int = 10) -> Column:
    """Names of a list, without et al."""
    text = rstrip(strip(c), ".,")
    parts = F.split(text, r"(?i)\s+and\s+|;\s*|,\s+(?=[A-Z][a-z'\-])")
    names = F.transform(parts, lambda p: rstrip(strip(p), ",."))
    kept = F.filter(names, lambda p: (F.length(p) > 1) & ~F.lower(F.replace(p, F.lit(" "), F.lit(""))).isin("etal", "etal.", "others"))
    return F.coalesce(F.slice(kept, 1, most), F.array().cast("array<string>"))


def doi_key(c: Column) -> Column:
    """How identifiers are compared."""
    return present(rstrip(F.lower(c), "/"))


def arxiv_key(c: Column) -> Column:
    """An arXiv id without its version."""
    return present(F.regexp_replace(c, r"v\d+$", ""))


def effective_doi(doi: Column, urls: Column) -> Column:
    """The cited identifier, else the first one inside the links."""
    inside = F.filter(F.transform(urls, lambda u: rstrip(F.regexp_extract(u, DOI_IN_URL, 1), TRAIL)), lambda x: x != "")
    return F.coalesce(present(doi), F.get(inside, F.lit(0)))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def unfence(c: Column) -> Column:
    """A model answer without code fences."""
    return strip(F.regexp_replace(c, r"```(?:json)?\s*|\s*```", ""))


def title_tokens(c: Column) -> Column:
    """Distinct lower-case words and numbers."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
