"""Bibliography files to references: detection and one parser per format.

A parser takes rows (doc_id, text) and returns references; entries are exploded, so a file
of any number of entries spreads. Only the balanced-brace scan of a BibTeX entry is Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import plaintext
from ..schemas import REFS, conform, present
from ..storage import discard, keep

# File suffixes and the formats they mean.
SUFFIXES = {".bib": "bibtex", ".ris": "ris", ".json": "csl_json", ".nbib": "nbib"}


# Identifiers in BibTeX fields.
EPRINT = r"^(\d{4}\.\d+|[a-z\-]+/\d+)"
BIBTEX_ARXIV = r"arxiv\.org/abs/([^\s/]+)"
BIBTEX_ENTRY = r"(?m)^(?=[^\S\n]*@\w+\s*[{(])"


def read_files(spark: SparkSession, path: str | list[str], hint: str | None = None, only: Column | None = None) -> DataFrame:
    """(path, format, text), a row per file; invalid bytes are replaced. The suffix decides the
    format, a hint overrides it, and anything else is sniffed. ``only`` chooses files by length;
    for files larger than a task see ``large``."""
    raw = spark.read.format("binaryFile").load(path).where(F.lit(True) if only is None else only).select("path", F.col("content").cast("binary").alias("b"))

    @F.pandas_udf(T.StringType())
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", errors="replace"))

    rows = raw.select("path", decode("b").alias("text"))
    by_suffix = F.coalesce(*(F.when(F.lower("path").endswith(s), F.lit(f)) for s, f in SUFFIXES.items()))
    return rows.select("path", (F.lit(hint) if hint else F.coalesce(by_suffix, sniff(F.col("text")))).alias("format"), "text")


def sniff(text: Column) -> Column:
    """The format that the first lines show."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"\S"))
    five = F.slice(lines, 1, 5)
    starts = lambda p: F.exists(five, lambda x: X.strip(x).rlike(p))
    return (
        F.when((F.size(five) > 0) & F.forall(five, lambda x: X.strip(x).rlike(r"^10\.\d{4,}/\S+")), "doi_list")
        .when(F.exists(F.slice(lines, 1, 10), lambda x: X.strip(x).rlike(r"^@\w+\{")), "bibtex")
        .when(starts(r"^TY  -"), "ris")
        .when(starts(r"^PMID-"), "nbib")
        .when(text.rlike(r"^\s*\[\s*\{") & F.try_parse_json(text).isNotNull(), "csl_json")
        .otherwise("plaintext")
    )


def _refs(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows (doc_id, pos, ...) with the given fields, as references. A pos of two parts is a large
    file's: the record or block, and the place in it; the reference's pos is the first."""
    made = rows.select("doc_id", "pos", *(c.alias(n) for n, c in columns.items()))
    two = isinstance(made.schema["pos"].dataType, T.StructType)
    place = F.to_json("pos") if two else F.col("pos").cast("string")
    made = made.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("ref_id", F.sha2(F.concat_ws("|", "doc_id", place), 256))
    return conform(made.withColumn("pos", F.col("pos")[made.schema["pos"].dataType.names[0]] if two else F.col("pos")), REFS)


def _arxiv_in(urls: Column) -> Column:
    return F.get(F.filter(F.transform(urls, lambda u: F.regexp_extract(u, X.ARXIV_URL, 1)), lambda x: x != ""), F.lit(0))


def _outside_arxiv(urls: Column) -> Column:
    return F.coalesce(F.filter(urls, lambda u: (u != "") & ~u.contains("arxiv.org")), F.array().cast("array<string>"))


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: A value is parts joined by #: text, or the name of a macro.
PARTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())]))


def scan_value(entry: str, at: int) -> tuple[list[dict[str, str | None]], int]:
    """The parts of a value from ``at`` on, and where it ends."""
    parts = []
    while True:
        at = re.compile(r"\s*").match(entry, at).end()
        start, depth, c = at, 0, entry[at : at + 1]
        if c in ("{", '"'):
            at += 1
            while at < len(entry) and not (depth == 0 and entry[at] == ("}" if c == "{" else '"')):
                if entry[at] == "}" and not depth:
                    break
                depth += {"{": 1, "}": -1}.get(entry[at], 0)
                at += 1
            parts.append({"name": None, "text": entry[start + 1 : at]})
            at += entry[at : at + 1] != "" and not (c == '"' and entry[at] == "}")
        else:
            at = re.compile(r"[^,#{}()]*").match(entry, at).end()
            word = entry[start:at].strip()
            macro = re.fullmatch(r"[^\W\d][\w:.+/-]*", word)
            parts.append({"name": word.lower() if macro else None, "text": word})
        joined = re.compile(r"\s*#").match(entry, at)
        if not joined:
            # what stands between a value's end and the next comma belongs to nobody
            return parts, re.compile(r"[^,]*,?" if re.compile(r"\s*[^\s,})]").match(entry, at) else r"\s*,?").match(entry, at).end()
        at = joined.end()


def scan_entry(entry: str) -> tuple[str, dict[str, list]] | None:
    """S3 for one entry: its kind and fields, by counting braces. A @string has its names as fields."""
    head = re.match(r"\s*@(\w+)\s*[{(]\s*", entry)
    if not head or head[1].lower() in ("comment", "preamble"):
        return None
    kind, out, at = head[1].lower(), {}, head.end()
    if kind != "string":
        key = re.compile(r"([^,\s]*)\s*,").match(entry, at)
        if not key:
            return None
        at = key.end()
    while m := re.compile(r"\s*([\w:.+/-]+)\s*=").match(entry, at):
        out[m[1].lower()], at = scan_value(entry, m.end())
    return kind, out


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), PARTS))]))
def bibtex_entry(entries: pd.Series) -> pd.DataFrame:
    found = [(e and scan_entry(e)) or (None, None) for e in entries]
    return pd.DataFrame({"kind": [k for k, _ in found], "fields": [f for _, f in found]})


def _filled(parts: Column, values: Column) -> Column:
    """Parts with the macros that ``values`` (a map) knows put in; of others the name stays."""
    return F.transform(parts, lambda p: F.struct(F.when(values[p["name"]].isNull(), p["name"]).alias("name"), F.coalesce(values[p["name"]], p["text"]).alias("text")))


def _text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def macros(entries: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, name, value) of a file's @string entries; of a name that is set twice the last. Values
    that are made of macros are filled in, from one to the next, up to ``most`` times; one that leads back to itself stays a name."""
    rows = entries.where("kind = 'string'").select("doc_id", "pos", F.explode("fields").alias("name", "parts"))
    rows = rows.groupBy("doc_id", "name").agg(F.max_by("parts", "pos").alias("parts"))
    months = F.map_from_entries(F.array(*(F.struct(F.lit(m[:3].lower()), F.lit(m)) for m in MONTHS)))
    rows = keep(rows.withColumn("parts", _filled(F.col("parts"), months)))
    for _ in range(most):
        open_ = rows.where(F.exists("parts", lambda p: p["name"].isNotNull()))
        uses = open_.select("doc_id", "name", F.explode(F.filter("parts", lambda p: p["name"].isNotNull())).alias("p")).select("doc_id", "name", F.col("p.name").alias("of")).where("name <> of")
        known = uses.join(rows.where(~F.exists("parts", lambda p: p["name"].isNotNull())).select("doc_id", F.col("name").alias("of"), _text(F.col("parts")).alias("value")), ["doc_id", "of"])
        if known.isEmpty():
            break
        put = known.groupBy("doc_id", "name").agg(F.map_from_entries(F.collect_set(F.struct("of", "value"))).alias("m"))
        better = keep(rows.join(put, ["doc_id", "name"], "left").select("doc_id", "name", F.when(F.col("m").isNull(), F.col("parts")).otherwise(_filled(F.col("parts"), F.col("m"))).alias("parts")))
        discard(rows)
        rows = better
    return rows.select("doc_id", "name", _text(F.col("parts")).alias("value"))


def parse_bibtex(texts: DataFrame) -> DataFrame:
    """S3. Macros hold in their own file; those of months are known everywhere. Each entry meets the
    few that it names by a join, so a file's macros are never gathered."""
    return _bibtex(texts.select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), BIBTEX_ENTRY)).alias("pos", "raw")))


def _bibtex(pieces: DataFrame) -> DataFrame:
    parts = pieces.where("raw rlike '@'")
    rows = keep(parts.select("doc_id", "pos", X.strip(F.col("raw")).alias("raw"), bibtex_entry("raw").alias("e")).where("e.kind IS NOT NULL").select("doc_id", "pos", "raw", "e.kind", "e.fields"))
    named = F.array_distinct(F.flatten(F.transform(F.map_values("fields"), lambda v: F.transform(F.filter(v, lambda p: p["name"].isNotNull()), lambda p: p["name"]))))
    works = rows.where("kind <> 'string'")
    uses = works.select("doc_id", "pos", F.explode(named).alias("name"))
    months = F.map_from_entries(F.array(*(F.struct(F.lit(m[:3].lower()), F.lit(m)) for m in MONTHS)))
    put = uses.join(macros(rows), ["doc_id", "name"]).groupBy("doc_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    works = works.join(put, ["doc_id", "pos"], "left").withColumn("m", F.coalesce("m", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    rows = works.withColumn("e", F.transform_values("fields", lambda _, v: _text(_filled(_filled(v, F.col("m")), months)))).drop("m", "fields")
    field = lambda n: present(X.strip(F.regexp_replace(F.regexp_replace(F.col("e")[n], r"[{}]", ""), r"\s+", " ")))
    url = field("url")
    authors = F.filter(F.transform(F.split(field("author"), r"(?i)\s+and\s+"), X.strip), lambda a: a != "")
    year, venue = F.regexp_substr(field("year"), F.lit(r"\d{4}")).try_cast("int"), F.coalesce(field("journal"), field("booktitle"), field("publisher"), field("school"))
    raw = F.concat_ws(" ", field("title"), present(F.array_join(F.slice(authors, 1, 2), " ")), F.when(year != 0, year).cast("string"), venue)
    return _refs(
        rows, raw=raw, title=field("title"), authors=authors, year=year, venue=venue, doi=field("doi"), pmid=field("pmid"),
        arxiv_id=F.coalesce(X.group(field("eprint"), EPRINT), X.group(url, BIBTEX_ARXIV)), urls=F.when(url.isNotNull() & ~url.contains("arxiv.org"), F.array(url)),
    )


def _base(texts: DataFrame) -> Column:
    """Where a text's records begin to count, for texts that are parts of files."""
    return (F.col("base") if "base" in texts.columns else F.lit(0)).alias("base")


def _tagged(texts: DataFrame, entry: str, line: str, fold: str | None = None) -> DataFrame:
    """Entries of ``TAG - value`` lines: (doc_id, pos, raw, t) with t an array of (tag, value)."""
    text = F.regexp_replace(F.col("text"), r"\r\n?", "\n")
    text = F.regexp_replace(text, fold, " ") if fold else text
    parts = texts.select("doc_id", _base(texts), F.posexplode(F.split(text, entry)).alias("pos", "raw")).where(F.col("raw").rlike(line)).withColumn("pos", F.col("base") + F.col("pos"))
    pairs = F.filter(
        F.transform(F.split("raw", "\n"), lambda x: F.struct(F.regexp_extract(x, line, 1).alias("tag"), X.strip(F.regexp_extract(x, line, 2)).alias("value"))), lambda p: p["tag"] != ""
    )
    return parts.select("doc_id", "pos", X.strip(F.col("raw")).alias("raw"), pairs.alias("t"))


def _all(*tags: str) -> Column:
    return F.transform(F.filter("t", lambda p: p["tag"].isin(*tags) & (p["value"] != "")), lambda p: p["value"])


def _first(*tags: str) -> Column:
    return F.coalesce(*(F.get(_all(t), F.lit(0)) for t in tags))


def parse_ris(texts: DataFrame) -> DataFrame:
    """S4."""
    rows = _tagged(texts, r"(?m)^ER  -[^\n]*$", r"(?m)^([A-Z][A-Z0-9])  - ?(.*)$")
    urls = _all("UR", "LK")
    number = _first("AN")
    return _refs(
        rows, raw=F.col("raw"), title=_first("TI", "T1"), authors=_all("AU", "A1"), year=F.regexp_substr(_first("PY", "Y1"), F.lit(r"\d{4}")).try_cast("int"), venue=_first("JO", "T2", "PB"),
        doi=_first("DO"), arxiv_id=_arxiv_in(urls), urls=_outside_arxiv(urls), pmid=F.when(number.rlike(r"^\d+$"), number),
    )


def parse_nbib(texts: DataFrame) -> DataFrame:
    """S6; records end at ER or where the next PMID begins."""
    rows = _tagged(texts, r"(?m)^ER  -[^\n]*$|^(?=PMID-)", r"(?m)^([A-Z]{2,4}) *- ?(.*)$", r"\n {6,}")
    doi = F.get(F.filter(F.transform(F.concat(_all("LID"), _all("AID")), lambda v: X.strip(F.regexp_replace(v, r"\s*\[doi\]$", ""))), lambda v: v.startswith("10.")), F.lit(0))
    links = F.filter(_all("AID"), lambda v: v.startswith("http"))
    return _refs(
        rows, raw=F.col("raw"), title=_first("TI", "T1"), authors=F.when(F.size(_all("AU")) > 0, _all("AU")).otherwise(_all("FAU")), year=F.regexp_substr(_first("DP"), F.lit(r"\d{4}")).try_cast("int"),
        venue=_first("JT", "SO", "T2"), doi=doi, urls=links, pmid=_first("PMID"),
    )


CSL = (
    "array<struct<title: string, author: array<struct<family: string, given: string, literal: string>>, editor: array<struct<family: string, given: string, literal: string>>, "
    "issued: struct<`date-parts`: array<array<string>>, raw: string>, accessed: struct<`date-parts`: array<array<string>>>, `container-title`: string, publisher: string, "
    "`collection-title`: string, DOI: string, URL: string, PMID: string>>"
)


def parse_csl_json(texts: DataFrame) -> DataFrame:
    """S5; one object is a list of one."""
    text = X.strip(F.col("text"))
    listed = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rows = texts.select("doc_id", F.posexplode(F.from_json(listed, CSL)).alias("pos", "e"))
    name = lambda a: present(X.strip(F.coalesce(F.concat_ws(" ", present(a["given"]), present(a["family"])), F.lit(""))))
    names = lambda c: F.array_compact(F.transform(c, lambda a: F.coalesce(name(a), present(a["literal"]))))
    who = F.when(F.size("e.author") > 0, names(F.col("e.author"))).otherwise(names(F.col("e.editor")))
    part = lambda c: F.get(F.get(F.col(f"{c}.`date-parts`"), F.lit(0)), F.lit(0)).try_cast("int")
    year = F.coalesce(part("e.issued"), F.regexp_substr("e.issued.raw", F.lit(r"\d{4}")).try_cast("int"), part("e.accessed"))
    url = present(F.col("e.URL"))
    return _refs(
        rows, raw=F.to_json("e"), title=F.col("e.title"), authors=who, year=year, venue=F.coalesce(present(F.col("e.`container-title`")), present(F.col("e.publisher")), present(F.col("e.`collection-title`"))),
        doi=F.col("e.DOI"), arxiv_id=X.group(url, X.ARXIV_URL), urls=F.when(url.isNotNull() & ~url.contains("arxiv.org"), F.array(url)), pmid=F.col("e.PMID"),
    )


def parse_doi_list(texts: DataFrame) -> DataFrame:
    """S7."""
    rows = texts.select("doc_id", _base(texts), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("pos", F.col("base") + F.col("pos"))
    return _refs(rows.withColumn("doi", X.find_doi(F.col("raw"))).where("doi IS NOT NULL"), raw=X.strip(F.col("raw")), doi=F.col("doi"))


TEI_TITLES = "array<struct<_VALUE: string, _level: string>>"
TEI_AUTHORS = "array<struct<persName: struct<forename: array<struct<_VALUE: string>>, surname: string>>>"
TEI = (
    f"analytic struct<title: {TEI_TITLES}, author: {TEI_AUTHORS}, idno: array<struct<_VALUE: string, _type: string>>, ptr: array<struct<_target: string>>>, "
    f"monogr struct<title: {TEI_TITLES}, author: {TEI_AUTHORS}, idno: array<struct<_VALUE: string, _type: string>>, imprint: struct<date: array<struct<_when: string>>>>, "
    "idno array<struct<_VALUE: string, _type: string>>, ptr array<struct<_target: string>>"
)


def parse_tei(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of TEI; works without title and identifiers are dropped."""
    one = F.regexp_extract_all("text", F.lit(r"(?s)<biblStruct\b.*?</biblStruct>"), F.lit(0))
    return tei_refs(texts.select("doc_id", F.posexplode(one).alias("pos", "raw")).withColumn("e", F.from_xml("raw", f"struct<{', '.join(_ddl_fields(TEI))}>")))


def tei_refs(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, raw, e) with parsed works."""
    titles = F.coalesce(F.filter("e.analytic.title", lambda t: F.coalesce(t["_level"], F.lit("a")).isin("a", "m")), F.array().cast(TEI_TITLES))
    title = F.coalesce(F.get(titles, F.lit(0))["_VALUE"], F.get("e.monogr.title", F.lit(0))["_VALUE"])
    people = F.when(F.size("e.analytic.author") > 0, F.col("e.analytic.author")).otherwise(F.col("e.monogr.author"))
    name = lambda a: F.concat_ws(", ", present(a["persName"]["surname"]), present(F.concat_ws(" ", F.transform(a["persName"]["forename"], lambda f: f["_VALUE"]))))
    authors = F.filter(F.transform(people, name), lambda x: x != "")
    none = F.array().cast("array<struct<_VALUE: string, _type: string>>")
    ids = F.concat(*(F.coalesce(f"e.{p}", none) for p in ("analytic.idno", "monogr.idno", "idno")))
    kind = lambda k: F.get(F.transform(F.filter(ids, lambda i: F.lower(i["_type"]) == k), lambda i: X.strip(i["_VALUE"])), F.lit(0))
    empty = F.array().cast("array<struct<_target: string>>")
    links = F.filter(F.transform(F.concat(F.coalesce("e.analytic.ptr", empty), F.coalesce("e.ptr", empty)), lambda p: p["_target"]), lambda u: u.startswith("http") & ~u.contains("doi.org"))
    arxiv = F.regexp_replace(kind("arxiv"), r"(?i)^arxiv:", "")
    made = _refs(
        rows, raw=F.col("raw"), title=X.strip(title), authors=authors, year=F.regexp_substr(F.get("e.monogr.imprint.date", F.lit(0))["_when"], F.lit(r"\d{4}")).try_cast("int"),
        venue=F.when(F.size(titles) > 0, X.strip(F.get("e.monogr.title", F.lit(0))["_VALUE"])), doi=kind("doi"), arxiv_id=arxiv, urls=links,
    )
    return made.where("title IS NOT NULL OR doi IS NOT NULL OR arxiv_id IS NOT NULL")


def _ddl_fields(ddl: str) -> list[str]:
    """Top-level fields of a table schema, written as those of a struct."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append(f"{name}: {kind}")
            start = i + 1
    return out


PARSERS = {"bibtex": parse_bibtex, "ris": parse_ris, "csl_json": parse_csl_json, "nbib": parse_nbib, "doi_list": parse_doi_list, "tei": parse_tei, "plaintext": plaintext.parse_lists}


def parse_files(files: DataFrame) -> DataFrame:
    """Rows (path, format, text) to references, whatever their formats."""
    out = None
    for name, parse in PARSERS.items():
        part = parse(files.where(F.col("format") == name).select(F.col("path").alias("doc_id"), "text"))
        out = part if out is None else out.unionByName(part)
    return out
