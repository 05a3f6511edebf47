"""References out of running text: locating the list, splitting it, reading its fields."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schemas import REFS, conform, present

# Styles in order of preference at ties, and the patterns that point to them.
STYLES = ("IEEE", "APA", "VANCOUVER", "MLA", "CHICAGO", "LNCS", "UNKNOWN")
NAME = r"[A-Z][a-zA-ZÀ-ÿ\-\.']+"
LNCS_START = r"^[A-Z][a-zA-ZÀ-ÿ\-]+,\s+[A-Z]\."
SIGNALS = {
    "IEEE": ((r'"[^"]{5,}",?\s+in\s+|"[^"]{5,}[,."]\s+[A-Z].*\d{4}|"[^"]{5,}".*\d{4}', 2), (r'"[^"]{5,}"', 1)),
    "APA": ((r"[A-Z][a-z]+,\s+[A-Z]\.\s+\(\d{4}\)", 2), (r"\(\d{4}\)", 1)),
    "VANCOUVER": ((r"\d{4};\d+[\s(]", 2), (r"\d{4};\d+\(\d+\):\d+", 1)),
    "MLA": ((r'"[^"]+"\s+.*vol\.\s+\d+.*\(\d{4}\)', 2),),
    "CHICAGO": ((r"\(\w+:\s*\w+,\s*\d{4}\)", 2),),
    "LNCS": ((LNCS_START + r".*: ", 2),),
}
AUTHOR_YEAR = r"[^\S\n]*[A-Z][a-zA-ZÀ-ÿ\-']+,?[^\S\n]+(?:[A-Z]\.?[^\S\n]*)+(?:\d{4}|,)"
WORDS = "REFERENCES|References|BIBLIOGRAPHY|Bibliography"
HEADINGS = [
    rf"\n[\s\d\t\r\xa0]*\d+\.?\s+(?:{WORDS})\s*:?\s*\n",
    rf"\n[\s\t\r\xa0\d]*(?:{WORDS}|WORKS\s+CITED|Works\s+Cited|LITERATURE\s+CITED|Literature\s+Cited|CITED\s+WORKS|Cited\s+Works)\s*:?\s*(?:\d*\s*)\n",
    rf"\n[\s\t\r\xa0\d]*(?:{WORDS})\s*:?\s+(?=[A-Z\d\[\(])",
    r"\d+\s*\t\s*(?:References|REFERENCES)\s*\d*\s*\t",
    rf"\s(?:{WORDS})\s*:?\s+(?=\d|[A-Z])",
]
LATE_HEADING = rf"\n[^\n]{{0,20}}?\b(?:{WORDS})\b\s*:?\s*\n"
END_SECTIONS = (
    "appendix", r"supplementary\s+material", r"supplemental\s+material", "acknowledgments?", "acknowledgements?", r"author\s+contributions?", "funding",
    r"ethics\s+statement", r"conflict\s+of\s+interest", r"data\s+availability", r"about\s+the\s+authors?", "index", "glossary",
)
YEAR_TOKEN = r"(?:\d{4}|n\.d\.)"


def locate_section(text: str) -> str:
    """P2 for one text: what follows its last bibliography heading, up to an end section."""
    size = len(text)
    hits = [m.span() for p in HEADINGS for m in re.finditer(p, text) if m.start() >= int(size * 0.2)]
    if not hits:
        hits = [m.span() for m in re.finditer(LATE_HEADING, text) if m.start() > size * 0.4]
    if not hits:
        return text
    start = max(a for a, _ in hits)
    lines = text[next(b for a, b in hits if a == start) :].strip().splitlines()
    ends = re.compile(rf"\s*(?:{'|'.join(END_SECTIONS)})\s*\.?\s*$", re.I)
    stop = next((i for i, line in enumerate(lines) if i > 5 and ends.match(line.strip())), len(lines))
    return "\n".join(lines[:stop])


@F.pandas_udf(T.StringType())
def reference_section(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else locate_section(t))


def split_list(text: Column) -> Column:
    """P5: chunks of a reference list by the first strategy that yields two or more."""
    t = X.unhyphenate(F.regexp_replace(text, r"\r\n?", "\n"))
    led = F.concat(F.lit("\n"), t)
    after_first = lambda pattern: F.slice(F.split(led, pattern), 2, 1 << 20)  # noqa: E731  lines before the first marker go
    filled = F.array_join(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"(?U)\S")), "\n")
    ways = [
        after_first(r"\n(?=" + X.MARKER + ")"),
        F.split(t, r"\n[^\S\n]*(?:\n[^\S\n]*)+"),
        F.split(F.concat(F.lit("\n"), filled), r"\n(?=\S)"),
        after_first(r"\n(?=" + AUTHOR_YEAR + ")"),
    ]
    clean = lambda w: F.filter(F.transform(w, X.clean_chunk), lambda c: c != "")
    chain = None
    for w in map(clean, ways):
        chain = F.when(F.size(w) >= 2, w) if chain is None else chain.when(F.size(w) >= 2, w)
    return chain.otherwise(clean(F.array(t)))


def detect_style(chunks: Column) -> Column:
    """The style with most signals in the first five chunks, two at least."""
    sample = F.slice(chunks, 1, 5)

    def points(style: str) -> Column:
        each = lambda c: sum((F.when(c.rlike(p), n).otherwise(0) for p, n in SIGNALS[style]), F.lit(0))
        return F.aggregate(sample, F.lit(0), lambda acc, c: acc + each(c))

    score = {s: points(s) for s in STYLES[:-1]}
    best = F.greatest(*score.values())
    chain = F.when(best < 2, F.lit("UNKNOWN"))
    for s in STYLES[:-1]:
        chain = chain.when(score[s] == best, F.lit(s))
    return chain


def _fields(title: Column | None, authors: Column | None = None, venue: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (none if title is None else title).alias("title"),
        F.coalesce(authors if authors is not None else F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias("authors"),
        (none if venue is None else venue).alias("venue"),
    )


def ieee(c: Column) -> Column:
    """P11."""
    return _fields(X.group(c, r'"([^"]{10,})"'), F.when(c.contains('"'), X.author_list(F.substring_index(c, '"', 1))))


def apa(c: Column) -> Column:
    """P12."""
    whole = rf"^((?:{NAME},?\s+[A-Z]\.?,?\s*(?:&\s*)?)+)\s*\({YEAR_TOKEN}\)\.\s*([^.]+\.)"
    title = F.coalesce(X.rstrip(X.strip(X.group(c, whole, 2)), "."), X.group(c, rf"\({YEAR_TOKEN}\)\.\s+([^.]+)\."))
    return _fields(title, F.when(c.rlike(whole), X.author_list(F.regexp_extract(c, whole, 1))))


def vancouver(c: Column) -> Column:
    """P13."""
    whole = rf"^(?:\d+\.\s+)?((?:{NAME}\s+[A-Z]{{1,3}},?\s*)+)\.\s+([^.]+)\."
    return _fields(X.strip(X.group(c, whole, 2)), F.when(c.rlike(whole), X.author_list(F.regexp_extract(c, whole, 1))))


def lncs(c: Column) -> Column:
    """Authors before the first colon, title up to a sentence end, venue up to the year."""
    names = F.substring_index(c, ": ", 1)
    rest = X.strip(F.substring(c, F.length(names) + 3, F.length(c)))
    fits = c.contains(": ") & names.rlike(r"[A-Z][a-z]+,\s+[A-Z]\.")
    sentence = r"^(.+?)\.\s+(?=[A-Z(])"
    parted = rest.rlike(sentence)
    after = X.strip(F.regexp_replace(rest, sentence, ""))
    venue = F.regexp_extract(after, r"(?i)^(?:In:\s*)?(.+?)(?:\.\s*(?:pp\.\s*[\d–-]+|vol\.\s*\d)|\s*\(\d{4}\)|$)", 1)
    raw = F.when(parted, X.strip(F.regexp_extract(rest, sentence, 1))).otherwise(X.strip(F.substring_index(rest, ". ", 1)))
    title = X.strip(F.regexp_replace(raw, r",?\s*https?://\S+", ""))
    title = present(X.strip(X.rstrip(X.strip(F.regexp_replace(title, r"\s*\(\d{4}\),?\s*$", "")), ".,")))
    return F.when(fits, _fields(title, X.author_list(names), F.when(parted, present(X.strip(X.rstrip(X.strip(venue), ".,")))))).otherwise(_fields(None))


def generic(c: Column) -> Column:
    """A quoted title, else the colon form, else the second or third sentence."""
    quoted = X.group(c, r'"([^"]{10,})"')
    colon = lncs(c)
    sentences = F.transform(F.slice(F.split(c, r"(?<=[.!?])\s+"), 2, 2), X.strip)
    fit = F.get(F.filter(sentences, lambda s: (F.length(s) > 20) & ~s.rlike(r"^[A-Z]{2,}")), F.lit(0))
    plain = _fields(None)
    return (
        F.when(quoted.isNotNull(), _fields(quoted))
        .when(colon["title"].isNotNull(), _fields(colon["title"], colon["authors"]))
        .when(fit.isNotNull(), _fields(X.rstrip(fit, ".")))
        .otherwise(plain)
    )


def fields_by_style(c: Column, style: Column) -> Column:
    """P17's part that depends on the style."""
    springer, other = lncs(c), generic(c)
    mixed = F.when(springer["title"].isNotNull(), springer).otherwise(
        _fields(other["title"], F.when(F.size(springer["authors"]) > 0, springer["authors"]).otherwise(other["authors"]), springer["venue"])
    )
    return F.when(style == "IEEE", ieee(c)).when(style == "APA", apa(c)).when(style == "VANCOUVER", vancouver(c)).when(style == "LNCS", mixed).otherwise(other)


def year_beside(c: Column, title: Column) -> Column:
    """P10 on what stands around the title, which may hold numbers like years; else the first year of all."""
    at = F.position(title, c)
    return F.coalesce(X.find_year(F.when(at > 0, F.overlay(c, F.lit(" "), at, F.length(title)))), X.find_year(c))


def extract_fields(chunks: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, raw, style) to references."""
    c = F.col("raw")
    found = chunks.withColumn("_f", fields_by_style(c, F.col("style"))).withColumn("urls", X.find_urls(c))
    return conform(
        found.select(
            F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("pos").cast("string")), 256).alias("ref_id"),
            F.col("doc_id").cast("string").alias("doc_id"),
            "pos",
            "raw",
            "_f.title",
            "_f.authors",
            year_beside(c, F.col("_f.title")).alias("year"),
            "_f.venue",
            X.find_doi(c).alias("doi"),
            X.find_arxiv(c, F.col("urls")).alias("arxiv_id"),
            "urls",
        ),
        REFS,
    )


def parse_lists(texts: DataFrame, style: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of reference lists to references; no shuffle."""
    chunked = texts.select("doc_id", split_list(F.coalesce("text", F.lit(""))).alias("chunks"))
    styled = chunked.withColumn("style", F.lit(style) if style else detect_style(F.col("chunks")))
    return extract_fields(styled.select("doc_id", "style", F.posexplode("chunks").alias("pos", "raw")))


def mine_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of whole documents to references."""
    return parse_lists(docs.select("doc_id", reference_section(X.unmark_headings(F.col("text"))).alias("text")))


RECOVERY_PROMPT = (
    "Read the bibliographic fields out of the reference below. Answer with one JSON object and nothing else, with the keys title, authors (list of strings), "
    "year (integer), venue, doi, arxiv_id, urls (list); null where unknown.\n\nThe text may be garbled; recover the real values where you can.\n\nReference:\n%s\n\nJSON:"
)


def recovery_prompts(refs: DataFrame) -> DataFrame:
    """P20: references that patterns could not read, with a prompt for a model."""
    unread = present(F.col("title")).isNull() & present(F.col("doi")).isNull() & present(F.col("arxiv_id")).isNull()
    return refs.where(unread & (F.length(X.strip(F.col("raw"))) > 0)).select("ref_id", F.format_string(RECOVERY_PROMPT, "raw").alias("prompt"))


def merge_recovered(refs: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (ref_id, response) replace a reference if they name a title or an id."""
    ddl = "title string, authors array<string>, year string, venue string, doi string, arxiv_id string, urls array<string>"
    unread = present(F.col("title")).isNull() & present(F.col("doi")).isNull() & present(F.col("arxiv_id")).isNull()
    given = answers.select(F.col("ref_id").alias("_id"), F.from_json(X.unfence(F.col("response")), ddl).alias("a")).groupBy("_id").agg(F.min("a").alias("a"))
    joined = refs.join(given, F.col("ref_id") == F.col("_id"), "left")
    use = unread & F.coalesce(present(F.col("a.title")), present(F.col("a.doi")), present(F.col("a.arxiv_id"))).isNotNull()
    pick = lambda n, v: F.when(use, v).otherwise(F.col(n)).alias(n)
    out = joined.select(
        "ref_id", "doc_id", "pos", "raw", *(pick(n, F.col(f"a.{n}")) for n in ("title", "authors")), pick("year", F.col("a.year").try_cast("int")),
        *(pick(n, F.col(f"a.{n}")) for n in ("venue", "doi", "arxiv_id", "urls")), pick("pmid", F.lit(None).cast("string")),
    )
    return conform(out, REFS)
