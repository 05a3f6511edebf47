"""Snapshots of scholarly sources to one catalog. Rows hold a JSON or XML payload each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CATALOG, REGISTRY, Source, conform, present, priority

# Payload schemas, explicit so that nothing is inferred.
OPENALEX = (
    "id string, title string, doi string, publication_year int, authorships array<struct<author: struct<display_name: string>>>, "
    "primary_location struct<source: struct<display_name: string>, landing_page_url: string>, ids struct<arxiv: string>, abstract string"
)
CROSSREF = (
    "DOI string, title array<string>, author array<struct<given: string, family: string>>, `published-print` struct<`date-parts`: array<array<int>>>, "
    "`published-online` struct<`date-parts`: array<array<int>>>, issued struct<`date-parts`: array<array<int>>>, `container-title` array<string>, URL string"
)
SEMANTIC = "paperId string, title string, authors array<struct<name: string>>, year int, venue string, externalIds struct<DOI: string, ArXiv: string>, abstract string, url string"
ARXIV = (
    "struct<title: string, published: string, id: string, author: array<struct<name: string>>, summary: string, `arxiv:doi`: string, doi: string>"
)
DBLP = "info struct<title: string, year: string, doi: string, venue: string, ee: string, authors: struct<author: string>, url: string>"
PUBMED = (
    "struct<MedlineCitation: struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>, "
    "AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>, Abstract: struct<AbstractText: array<string>>>>, "
    "PubmedData: struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>>"
)
GOOGLE_BOOKS = "id string, volumeInfo struct<title: string, authors: array<string>, publishedDate: string, publisher: string, industryIdentifiers: array<struct<type: string, identifier: string>>, infoLink: string>"
UNPAYWALL = "doi string, best_oa_location struct<url_for_pdf: string, url: string>"


def _catalog(rows: DataFrame, source: str, work: Column, **columns: Column) -> DataFrame:
    made = rows.select(*(c.alias(n) for n, c in columns.items()), F.lit(source).alias("source"), work.alias("_work"))
    made = made.withColumn("work_id", F.concat_ws(":", "source", F.coalesce("_work", F.sha2(F.to_json(F.struct(*columns)), 256)))).withColumn("source_priority", priority(F.col("source")))
    return conform(made, CATALOG)


def _json(payloads: DataFrame, ddl: str) -> DataFrame:
    return payloads.select(F.from_json("payload", ddl).alias("p")).where("p IS NOT NULL").select("p.*")


def _names(c: Column) -> Column:
    return F.filter(c, lambda x: F.length(x) > 0)


def _plain_doi(c: Column) -> Column:
    return present(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", ""))


def shape_openalex(rows: DataFrame) -> DataFrame:
    """S9."""
    p = rows
    return _catalog(
        p, "OpenAlex", present(F.col("id")), title=F.col("title"), authors=_names(F.transform("authorships", lambda a: a["author"]["display_name"])), year=F.col("publication_year"),
        venue=F.col("primary_location.source.display_name"), doi=_plain_doi(F.col("doi")), arxiv_id=X.arxiv_key(F.regexp_replace("ids.arxiv", r"^(https?://arxiv\.org/abs/|(?i:arxiv:))", "")),
        urls=F.array_compact(F.array("primary_location.landing_page_url")), abstract=F.col("abstract"),
    )


def shape_crossref(rows: DataFrame) -> DataFrame:
    """S10."""
    p = rows
    year = F.coalesce(*(F.get(F.get(F.col(f"`{n}`.`date-parts`"), F.lit(0)), F.lit(0)) for n in ("published-print", "published-online", "issued")))
    names = _names(F.transform("author", lambda a: F.concat_ws(" ", present(a["given"]), present(a["family"]))))
    return _catalog(
        p, "Crossref", present(F.col("DOI")), title=F.get("title", F.lit(0)), authors=names, year=year, venue=F.get("`container-title`", F.lit(0)), doi=F.col("DOI"), urls=F.array_compact(F.array("URL"))
    )


def shape_semantic_scholar(rows: DataFrame) -> DataFrame:
    """Papers without a title are dropped."""
    p = rows.where(F.length("title") > 0)
    return _catalog(
        p, "Semantic Scholar", present(F.col("paperId")), title=F.col("title"), authors=_names(F.transform("authors", lambda a: a["name"])), year=F.col("year"), venue=F.col("venue"),
        doi=F.col("externalIds.DOI"), arxiv_id=F.col("externalIds.ArXiv"), urls=F.array_compact(F.array("url")), abstract=F.col("abstract"),
    )


def shape_arxiv(rows: DataFrame) -> DataFrame:
    """Ids keep no version."""
    p = rows
    squeeze = lambda c: X.strip(F.regexp_replace(c, r"\s+", " "))
    key = X.arxiv_key(X.group(F.col("id"), r"/abs/(\S+)$"))
    return _catalog(
        p, "arXiv", key, title=squeeze(F.col("title")), authors=_names(F.transform("author", lambda a: X.strip(a["name"]))), year=F.substring("published", 1, 4).try_cast("int"), venue=F.lit("arXiv"),
        doi=F.coalesce("`arxiv:doi`", "doi"), arxiv_id=key, urls=F.array_compact(F.array(X.strip(F.col("id")))), abstract=squeeze(F.col("summary")),
    )


def shape_dblp(rows: DataFrame) -> DataFrame:
    """An author is a string, an object or a list of either."""
    p = rows.select("info.*")
    a = F.trim("authors.author")
    many = F.from_json(a, "array<struct<text: string>>")
    plain = F.from_json(a, "array<string>")
    names = (
        F.when(a.startswith("["), F.when(a.rlike(r"^\[\s*\{"), F.transform(many, lambda x: x["text"])).otherwise(plain))
        .when(a.startswith("{"), F.array(F.from_json(a, "text string")["text"]))
        .when(a.isNotNull(), F.array(a))
    )
    return _catalog(
        p, "DBLP", F.coalesce(present(F.col("url")), present(F.col("doi"))), title=F.col("title"), authors=_names(names), year=F.when(F.col("year").rlike(r"^\d+$"), F.col("year").try_cast("int")),
        venue=F.col("venue"), doi=F.col("doi"), urls=F.array_compact(F.array("ee")),
    )


def shape_pubmed(rows: DataFrame) -> DataFrame:
    """S14."""
    p = rows.select("MedlineCitation.PMID", "MedlineCitation.Article", "PubmedData.ArticleIdList.ArticleId")
    doi = F.get(F.transform(F.filter("ArticleId", lambda i: i["_IdType"] == "doi"), lambda i: X.strip(i["_VALUE"])), F.lit(0))
    names = _names(F.transform("Article.AuthorList.Author", lambda a: F.concat_ws(" ", present(a["ForeName"]), present(a["LastName"]))))
    return _catalog(
        p, "PubMed", present(F.col("PMID")), title=F.col("Article.ArticleTitle"), authors=names, year=F.col("Article.Journal.JournalIssue.PubDate.Year").try_cast("int"), venue=F.col("Article.Journal.Title"),
        doi=doi, pmid=F.col("PMID"), abstract=F.array_join("Article.Abstract.AbstractText", " "),
    )


def shape_google_books(rows: DataFrame) -> DataFrame:
    """Book numbers stay out of the DOI column."""
    p = rows.select("id", "volumeInfo.*")
    number = lambda k: F.get(F.transform(F.filter("industryIdentifiers", lambda i: i["type"] == k), lambda i: i["identifier"]), F.lit(0))
    return _catalog(
        p, "Google Books", present(F.col("id")), title=F.col("title"), authors=_names(F.col("authors")), year=F.regexp_substr("publishedDate", F.lit(X.YEAR)).try_cast("int"), venue=F.col("publisher"),
        isbn=F.coalesce(number("ISBN_13"), number("ISBN_10")), urls=F.array_compact(F.array("infoLink")),
    )


@dataclass(frozen=True)
class Dump:
    """A source's records: schema, mapping to catalog rows, the id that updates repeat, and for XML the
    element that is a record."""

    ddl: str
    shape: Callable[[DataFrame], DataFrame]
    key: str = ""
    row_tag: str = ""


def _fields(struct: str) -> str:
    """The inside of a struct type, which is a table's schema too."""
    return struct.removeprefix("struct<").removesuffix(">")


DUMPS = {
    "Crossref": Dump(CROSSREF, shape_crossref, "DOI"), "OpenAlex": Dump(OPENALEX, shape_openalex, "id"), "Semantic Scholar": Dump(SEMANTIC, shape_semantic_scholar, "paperId"),
    "arXiv": Dump(_fields(ARXIV), shape_arxiv, row_tag="entry"), "PubMed": Dump(_fields(PUBMED), shape_pubmed, row_tag="PubmedArticle"), "DBLP": Dump(DBLP, shape_dblp, "info.url"),
    "Google Books": Dump(GOOGLE_BOOKS, shape_google_books, "id"),
}


def _from_payloads(dump: Dump) -> Callable[[DataFrame], DataFrame]:
    def read(payloads: DataFrame) -> DataFrame:
        parsed = F.from_xml("payload", f"struct<{dump.ddl}>") if dump.row_tag else F.from_json("payload", dump.ddl)
        return dump.shape(payloads.select(parsed.alias("p")).where("p IS NOT NULL").select("p.*"))

    return read


#: By source, a function from rows with a payload each to catalog rows.
MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {name: _from_payloads(dump) for name, dump in DUMPS.items()}
from_crossref, from_openalex, from_semantic_scholar, from_arxiv = (MAPPERS[n] for n in ("Crossref", "OpenAlex", "Semantic Scholar", "arXiv"))
from_pubmed, from_dblp, from_google_books = (MAPPERS[n] for n in ("PubMed", "DBLP", "Google Books"))


def register(name: str, mapper: Callable[[DataFrame], DataFrame], source: Source) -> None:
    """A new source: a function from payload rows to catalog rows, and what matching has to know of
    it. Every tier, tie and filter reads that record."""
    MAPPERS[name] = mapper
    REGISTRY[name] = source


def unregister(name: str) -> None:
    MAPPERS.pop(name, None)
    REGISTRY.pop(name, None)


def catalog_rows(rows: DataFrame, source: str, work: Column, **columns: Column) -> DataFrame:
    """For mappers: columns of the catalog under a source's name and priority; ``work`` is the
    source's own id, or null to make one of the content."""
    return _catalog(rows, source, work, **columns)


def union_catalog(payloads: dict[str, DataFrame]) -> DataFrame:
    """One catalog over the snapshots of several sources."""
    out = None
    for source, rows in payloads.items():
        part = MAPPERS[source](rows)
        out = part if out is None else out.unionByName(part)
    return out


def open_access(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Refs with ``oa_url`` by normalized DOI."""
    p = _json(payloads, UNPAYWALL)
    url = F.coalesce(present(F.col("best_oa_location.url_for_pdf")), present(F.col("best_oa_location.url")))
    best = p.select(X.doi_key(F.col("doi")).alias("_key"), url.alias("oa_url")).where("_key IS NOT NULL AND oa_url IS NOT NULL").groupBy("_key").agg(F.min("oa_url").alias("oa_url"))
    return refs.withColumn("_key", X.doi_key(F.col("doi"))).join(best, "_key", "left").drop("_key")
