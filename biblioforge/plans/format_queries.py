"""Registered queries over works rendered as source payloads, mixed files and citation text,
each with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import plaintext as P
from ..sources import catalog as G
from ..sources import formats, large
from ..storage import delete, discard, keep, shared_path
from . import derived as D
from .queries import CAT, N, PLAIN, _rendered


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


TITLE, VENUE = _escaped("coalesce(title, '')"), _escaped("venue")
# names are "surname, initial"
LAST, FIRST = _escaped("split(a, ', ')[0]"), _escaped("split(a, ', ')[1]")

PAYLOADS = {
    "PubMed": f"""concat('<PubmedArticle><MedlineCitation><PMID>', n, '</PMID><Article><Journal><JournalIssue><PubDate><Year>', year, '</Year></PubDate></JournalIssue><Title>', {VENUE}, '</Title></Journal><ArticleTitle>', {TITLE},
      '</ArticleTitle><AuthorList>', array_join(transform(authors, a -> concat('<Author><LastName>', {LAST}, '</LastName><ForeName>', {FIRST}, '</ForeName></Author>')), ''), '</AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList>',
      '<ArticleId IdType="pubmed">', n, '</ArticleId><ArticleId IdType="doi"> ', doi, ' </ArticleId></ArticleIdList></PubmedData></PubmedArticle>')""",
    # one author is a string, several are objects
    "DBLP": """if(n % 8 = 1, to_json(named_struct('info', named_struct('title', title, 'year', cast(year AS string), 'doi', doi, 'venue', venue, 'authors', named_struct('author', authors[0])))),
      to_json(named_struct('info', named_struct('title', title, 'year', cast(year AS string), 'doi', doi, 'venue', venue, 'authors', named_struct('author', transform(authors, a -> named_struct('text', a)))))))""",
    "Google Books": """to_json(named_struct('id', work_id, 'volumeInfo', named_struct('title', title, 'authors', authors, 'publishedDate', concat(year, '-01-02'), 'publisher', venue, 'industryIdentifiers',
      array(named_struct('type', 'ISBN_10', 'identifier', concat('10', n)), named_struct('type', if(n % 8 = 2, 'OTHER', 'ISBN_13'), 'identifier', concat('978', n))))))""",
    "arXiv": f"""concat('<entry><id> http://arxiv.org/abs/', arxiv_id, 'v3</id><title>', {TITLE}, '</title><published>', year, '-03-04T00:00:00Z</published>',
      array_join(transform(authors, a -> concat('<author><name>', {_escaped('a')}, '</name></author>')), ''), '<doi>', doi, '</doi></entry>')""",
}


def s12_s15_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth work as a payload of each source, mapped back to the catalog."""
    c = D.catalog(spark, sf).withColumn("n", F.substring("work_id", 2, 30).cast("long"))
    made = G.union_catalog({s: c.where(F.col("n") % 4 == k).select(F.expr(p).alias("payload")) for k, (s, p) in enumerate(PAYLOADS.items())})
    return made.select("source", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", "arxiv_id", "pmid", "isbn")


SOURCES_MAPPED = f"""
WITH c AS (SELECT *, {N} AS n, {N} % 4 AS k FROM {CAT})
SELECT CASE k WHEN 0 THEN 'PubMed' WHEN 1 THEN 'DBLP' WHEN 2 THEN 'Google Books' ELSE 'arXiv' END AS source, nullif(CASE WHEN k = 3 THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) ELSE title END, '') AS title,
  CASE WHEN k = 0 THEN array_to_string(list_transform(authors, lambda x: split_part(x, ', ', 2) || ' ' || split_part(x, ', ', 1)), '; ') WHEN n % 8 = 1 THEN authors[1] ELSE array_to_string(authors, '; ') END AS authors,
  year, CASE WHEN k = 3 THEN 'arXiv' ELSE venue END AS venue, CASE WHEN k <> 2 THEN doi END AS doi, CASE WHEN k = 3 THEN arxiv_id END AS arxiv_id, CASE WHEN k = 0 THEN n::STRING END AS pmid,
  CASE WHEN n % 8 = 2 THEN '10' || n WHEN k = 2 THEN '978' || n END AS isbn FROM c
"""


def s8_tei(spark: SparkSession, sf: str) -> DataFrame:
    entry = f"""concat('<biblStruct><analytic><title level="a">', {TITLE}, '</title>', array_join(transform(authors, a -> concat('<author><persName><forename type="first">', {FIRST}, '</forename><surname>', {LAST},
      '</surname></persName></author>')), ''), '<idno type="DOI">', doi, '</idno><ptr target="', urls[0], '"/><ptr target="https://doi.org/', doi, '"/></analytic><monogr><title level="j">', {VENUE},
      '</title><imprint><date when="', year, '-05"/></imprint></monogr></biblStruct>')"""
    refs = formats.parse_tei(_rendered(spark, sf, entry, "\n", ("<listBibl>", "</listBibl>")))
    return refs.select("title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", F.array_join("urls", " ").alias("urls"))


TEI_SQL = f"SELECT title, array_to_string(authors, '; ') AS authors, year, venue, doi, urls[1] AS urls FROM {CAT} WHERE length(title) > 0"


def s2_mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of four formats without a suffix, sniffed and parsed together."""
    entry = """CASE floor(n / 20) % 4 WHEN 0 THEN concat('@article{k', n, ',\n  title = {{', title, '}},\n  doi = {', doi, '}\n}') WHEN 1 THEN concat('TY  - JOUR\nTI  - ', title, '\nDO  - ', doi, '\nER  - ')
      WHEN 2 THEN concat('PMID- ', n, '\nTI  - ', title, '\nLID - ', doi, ' [doi]\n') ELSE doi END"""
    files = _rendered(spark, sf, entry).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), formats.sniff(F.col("text")).alias("format"), "text")
    return formats.parse_files(files).select("doc_id", "title", "doi")


MIXED = f"""SELECT 'f' || ({N} // 20) AS doc_id, CASE WHEN {N} // 20 % 4 < 3 THEN title END AS title, doi FROM {CAT} WHERE length(title) > 0"""


def p3_p8_p9_text(spark: SparkSession, sf: str) -> DataFrame:
    """Broken words, links and arXiv ids in every whole text with a reference behind it."""
    tail = """concat('\nhyphen-\n  ated see https://a.example.org/p/', doc_id, '), https://doi.org/10.1234/x; https://root.example.org/ ', CASE doc_id % 5 WHEN 0 THEN concat('https://arxiv.org/abs/2301.', doc_id, '.')
      WHEN 1 THEN concat('arxiv.org/abs/2302.', doc_id) WHEN 2 THEN concat('arXiv: 2303.', doc_id) WHEN 3 THEN concat('arxiv. org/abs/2304.', doc_id) ELSE '' END)"""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.expr(tail)).alias("t"))
    d = d.withColumn("u", X.find_urls(F.col("t")))
    return d.select("doc_id", F.md5(X.unhyphenate(F.col("t"))).alias("joined"), F.array_join("u", " ").alias("urls"), X.find_arxiv(F.col("t"), F.col("u")).alias("arxiv_id"))


# RE2 has no letters beyond ASCII in \w and \s, so they are spelt out
LETTER, SPACE = r"[\p{L}\p{M}\p{Nd}\p{Pc}]", r"[\s\v\p{Z}\x{85}]"
TEXT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'hyphen-' || chr(10) || '  ated see https://a.example.org/p/' || doc_id || '), https://doi.org/10.1234/x; https://root.example.org/ ' ||
  CASE doc_id % 5 WHEN 0 THEN 'https://arxiv.org/abs/2301.' || doc_id || '.' WHEN 1 THEN 'arxiv.org/abs/2302.' || doc_id WHEN 2 THEN 'arXiv: 2303.' || doc_id WHEN 3 THEN 'arxiv. org/abs/2304.' || doc_id ELSE '' END AS t FROM documents),
u AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, 'https?://[^\\s,;>"'')]+'), lambda x: rtrim(x, '.,;)>"''')), lambda x: NOT contains(x, 'doi.org') AND rtrim(regexp_extract(x, '^https?://[^/?#]*([^?#]*)', 1), '/') <> '') AS urls FROM d)
SELECT doc_id, md5(regexp_replace(t, '({LETTER})-\\n{SPACE}*({LETTER})', '\\1\\2', 'g')) AS joined, array_to_string(urls, ' ') AS urls,
  CASE WHEN doc_id % 5 < 4 THEN '230' || (doc_id % 5 + 1) || '.' || doc_id END AS arxiv_id FROM u
"""


def p15_generic_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Titles in quotes, or as the second sentence where no style is known."""
    c = D.catalog(spark, sf).where("title IS NOT NULL").withColumn("n", F.substring("work_id", 2, 30).cast("long"))
    entry = f"""if(n % 2 = 0, concat('Anonymous, "The ', {PLAIN}, ' and what follows" ', year), concat('Anonymous. The ', {PLAIN}, ' and what follows. ', year, '.'))"""
    return c.select("work_id", P.generic(F.expr(entry))["title"].alias("title"))


GENERIC = f"SELECT work_id, 'The ' || trim(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') || ' x') || ' and what follows' AS title FROM {CAT} WHERE length(title) > 0"



def s3_macros(spark: SparkSession, sf: str) -> DataFrame:
    """Files with @string macros: plain, joined, made of later macros, of months, and unknown ones."""
    head = '@string{both = pre # {all}}\n@STRING(pre = "Journal of ")\n@string{pre2 = {Old }}\n@string{pre2 = pre}\n\n'
    entry = (
        "concat('@article{k', n, ',\n  title = {', replace(title, '#', ''), '} # \" \" # apr,\n  author = {', array_join(authors, ' and '), '},\n  journal = ', CASE n % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'nowhere' "
        "WHEN 2 THEN concat('pre2 # {', substring(venue, 12, 100), '}') ELSE concat('PRE # \"', substring(venue, 12, 100), '\" ') END, ',\n  year = ', year, ',\n  doi = {', doi, '}\n}')"
    )
    refs = formats.parse_bibtex(_rendered(spark, sf, entry, around=(head, "")))
    return refs.select("title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi")


MACROS = f"""SELECT trim(replace(title, '#', '')) || ' April' AS title, array_to_string(authors, '; ') AS authors, year, CASE {N} % 4 WHEN 0 THEN 'Journal of all' WHEN 1 THEN 'nowhere' ELSE venue END AS venue, doi
FROM {CAT} WHERE length(title) > 0"""


def _written(rows: DataFrame, *by: str) -> str:
    """Texts as files of lines in the shared folder."""
    path = shared_path(rows.sparkSession, "files")
    (rows.write.partitionBy(*by) if by else rows.write).text(path)
    return path


def _works(spark: SparkSession, sf: str) -> DataFrame:
    return D.catalog(spark, sf).where("title IS NOT NULL").withColumn("n", F.substring("work_id", 2, 30).cast("long"))


SPLIT = {
    "bibtex": "concat('@article{k', n, ',\n  title = {{', title, '}},\n  note = {one\n@two},\n  doi = {', doi, '}\n}\n')", "ris": "concat('TY  - JOUR\nTI  - ', title, '\nDO  - ', doi, '\nER  - ')",
    "nbib": "concat('PMID- ', n, '\nTI  - ', title, '\nLID - ', doi, ' [doi]\n')", "doi_list": "concat('https://doi.org/', doi, '.')",
}


def s1_split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every work in a file of each of four formats, read record by record."""
    works, out, paths = keep(_works(spark, sf)), None, []
    for kind, entry in SPLIT.items():
        paths.append(_written(works.select(F.expr(entry))))
        refs = large.parse_split(spark, paths[-1], kind).select(F.lit(kind).alias("kind"), "title", "doi")
        out = refs if out is None else out.unionByName(refs)
    done = keep(out)
    discard(works)
    for p in paths:
        delete(spark, p)
    return done


SPLIT_FILES = f"""SELECT k.kind, CASE WHEN k.kind <> 'doi_list' THEN title END AS title, doi FROM {CAT}, (SELECT unnest(['bibtex', 'ris', 'nbib', 'doi_list']) AS kind) k WHERE length(title) > 0"""


def _xml_dump(spark: SparkSession, sf: str, source: str) -> tuple[DataFrame, DataFrame, str]:
    """A source's dump in which every fiftieth work has a broken record before its own."""
    works = D.catalog(spark, sf).withColumn("n", F.substring("work_id", 2, 30).cast("long")).where(F.col("n") % 4 == {"PubMed": 0, "arXiv": 3}[source])
    tag = G.DUMPS[source].row_tag
    record = F.expr(PAYLOADS[source])
    path = _written(works.select(F.when(F.floor(F.col("n") / 4) % 50 == 0, F.concat(F.lit(f"<{tag}><title>never < ended</{tag}>\n"), record)).otherwise(record)))
    return *large.catalog_of_dump(spark, path, source), path


def s12_s14_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """XML dumps with broken records by row tag."""
    made = [_xml_dump(spark, sf, s) for s in ("PubMed", "arXiv")]
    works = made[0][0].unionByName(made[1][0])
    out = keep(works.select("source", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", "arxiv_id", "pmid"))
    for _, _, path in made:
        delete(spark, path)
    return out


DUMPED = f"SELECT source, title, authors, year, venue, doi, arxiv_id, pmid FROM ({SOURCES_MAPPED}) WHERE source IN ('PubMed', 'arXiv')"


def s12_s14_broken_records(spark: SparkSession, sf: str) -> DataFrame:
    out, paths = None, []
    for source in ("PubMed", "arXiv"):
        _, read, path = _xml_dump(spark, sf, source)
        paths.append(path)
        counted = large.broken(read).select(F.lit(source).alias("source"), "records", "broken")
        out = counted if out is None else out.unionByName(counted)
    done = keep(out)
    for p in paths:
        delete(spark, p)
    return done


BROKEN = f"""SELECT CASE {N} % 4 WHEN 0 THEN 'PubMed' ELSE 'arXiv' END AS source, count(*) + count(*) FILTER ({N} // 4 % 50 = 0) AS records, count(*) FILTER ({N} // 4 % 50 = 0) AS broken FROM {CAT} WHERE {N} % 4 IN (0, 3) GROUP BY 1"""

# Two snapshots: all works, and a month later a third of them with another title and year.
SNAPSHOT = """to_json(named_struct('id', work_id, 'title', if(late, concat(title, ' revised'), title), 'doi', concat('https://doi.org/', doi), 'publication_year', if(late, year + 1, year),
  'authorships', transform(authors, a -> named_struct('author', named_struct('display_name', a)))))"""


def _snapshots(spark: SparkSession, sf: str) -> str:
    works = _works(spark, sf).select("*", F.explode(F.expr("if(n % 3 = 0, array(false, true), array(false))")).alias("late"))
    cut = F.when(F.col("n") % 40 == 0, F.concat(F.lit('{"id": "cut", "title": "no end\n'), F.expr(SNAPSHOT))).otherwise(F.expr(SNAPSHOT))
    return _written(works.select(cut.alias("value"), F.when(F.col("late"), "2024-02-01").otherwise("2024-01-01").alias("date")), "date")


def s9_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The newest record of each work over dated JSON-lines snapshots with broken lines."""
    path = _snapshots(spark, sf)
    works, _ = large.catalog_of_dump(spark, path, "OpenAlex")
    out = keep(works.select("work_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi"))
    delete(spark, path)
    return out


NEWEST = f"SELECT 'OpenAlex:' || work_id AS work_id, CASE WHEN {N} % 3 = 0 THEN title || ' revised' ELSE title END AS title, array_to_string(authors, '; ') AS authors, year + CASE WHEN {N} % 3 = 0 THEN 1 ELSE 0 END::INT AS year, doi FROM {CAT} WHERE length(title) > 0"


def s9_broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _snapshots(spark, sf)
    _, read = large.catalog_of_dump(spark, path, "OpenAlex")
    out = keep(large.broken(read, "date").select(F.col("date").cast("string").alias("date"), "records", "broken"))
    delete(spark, path)
    return out


BROKEN_LINES = f"""WITH x AS (SELECT {N} AS n FROM {CAT} WHERE length(title) > 0), s AS (SELECT n, '2024-01-01' AS date FROM x UNION ALL SELECT n, '2024-02-01' FROM x WHERE n % 3 = 0)
SELECT date, count(*) + count(*) FILTER (n % 40 = 0) AS records, count(*) FILTER (n % 40 = 0) AS broken FROM s GROUP BY 1"""

QUERIES = {f.__name__: f for f in (
    s12_s15_catalog, s8_tei, s2_mixed_files, p3_p8_p9_text, p15_generic_fields, s3_macros, s1_split_files, s12_s14_dumps, s12_s14_broken_records, s9_snapshots, s9_broken_lines,
)}

ORACLES = {
    "s12_s15_catalog": SOURCES_MAPPED, "s8_tei": TEI_SQL, "s2_mixed_files": MIXED, "p3_p8_p9_text": TEXT_SQL, "p15_generic_fields": GENERIC, "s3_macros": MACROS, "s1_split_files": SPLIT_FILES,
    "s12_s14_dumps": DUMPED, "s12_s14_broken_records": BROKEN, "s9_snapshots": NEWEST, "s9_broken_lines": BROKEN_LINES,
}
