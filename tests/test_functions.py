import random

from pyspark.sql import functions as F

from biblioforge.functions import similarity as S
from biblioforge.functions import text as X
from biblioforge.operators import checks as C
from biblioforge.operators import plaintext as P
from biblioforge.schemas import REFS, conform
from biblioforge.sources import catalog as G
from biblioforge.sources import formats


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def brute_ratio(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both, da, db = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not da or not db):
        return 1.0
    sect = len(both)
    la, lb = sect + bool(sect) + len(da), sect + bool(sect) + len(db)
    r = [100 - 100 * (len(da) + len(db) - 2 * dp_lcs(da, db)) / (la + lb)]
    if sect:
        r += [100 - 100 * (1 + len(da)) / (sect + la), 100 - 100 * (1 + len(db)) / (sect + lb)]
    return max(r) / 100


def test_token_set_ratio(spark):
    rng = random.Random(3)
    title = lambda: " ".join(rng.choice(["Deep", "learning", "of", "graphs", "é", "a", "nets", "survey"]) + rng.choice(["", "s"]) for _ in range(rng.randrange(0, 7)))
    pairs = [(title(), title()) for _ in range(200)] + [("", "x"), ("same", "SAME"), ("a b", "b a c")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - brute_ratio(r.a, r.b)) < 1e-9 for r in got)


def test_identifiers(spark):
    assert one(spark, "see doi:10.1000/abc.1). More", X.find_doi) == "10.1000/abc.1"
    assert one(spark, "a https://x.org/p). b https://doi.org/10.1/x https://arxiv", X.find_urls) == ["https://x.org/p"]
    assert one(spark, "arXiv:2005.14165, 1999", X.find_year) == 2005 and one(spark, "in 1999 and 2001", X.find_year) == 1999
    assert one(spark, "arXiv: 2308.07201 x", lambda c: X.find_arxiv(c, X.find_urls(c))) == "2308.07201"
    assert one(spark, "arxiv. org/abs/2308.07201", lambda c: X.find_arxiv(c, X.find_urls(c))) == "2308.07201"
    assert one(spark, "10.1/AB/", X.doi_key) == "10.1/ab"
    assert one(spark, "Vaswani, A.", S.surname) == "vaswani" and one(spark, "Ada M Lovelace", S.surname) == "lovelace"
    assert one(spark, "Smith, J., Doe, A. and Roe, B., et al.", X.author_list) == ["Smith, J", "Doe, A", "Roe, B"]


LIST = """[1] A. Smith and B. Jones, "A long enough title here," in Proc. Things, 2019, pp. 1-2.

[2] C. Brown, "Another quite long title," in Journal of Neu-
ral Things, 2020. doi:10.1000/xyz.

[3] D. Green, "Third one is also long," in Conf., 2021."""


def test_lists_and_styles(spark):
    rows = P.parse_lists(spark.createDataFrame([("d", LIST)], "doc_id string, text string")).orderBy("pos").collect()
    assert [r.title for r in rows] == ["A long enough title here,", "Another quite long title,", "Third one is also long,"]
    assert [r.year for r in rows] == [2019, 2020, 2021] and rows[1].doi == "10.1000/xyz" and "Neural" in rows[1].raw
    text = "Smith, J. (2019). A study of things. Journal.\n\nDoe, A. (2020). Another study here. Journal."
    rows = P.parse_lists(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("pos").collect()
    assert [r.title for r in rows] == ["A study of things", "Another study here"] and rows[0].authors == ["Smith, J"]


def test_years_in_titles(spark):
    """A title may hold numbers like years; the year is the first one beside it, or in it where there is no other."""
    lists = [
        '[1] A. Smith, "The +1 (235) 555-2058 calls again," in Proc. Things, 1998.\n\n[2] B. Jones, "Another quite long title," in Conf., 2001.\n\n[3] C. Green, "Looking back at 1984," unpublished.',
        "Smith A, Jones B. 94 182 555 1902 Oring x. Journal. 2007;12(3):45-67.\n\nSmith A, Jones B. Things of now. Journal. 2008;12(3):45-67.",
        "Smith, A., Jones, B.: The 555 1902 calls. Journal of Things (1996).\n\nSmith, A., Jones, B.: Things of now. Journal of Things (1997).",
        "Smith, A. (2019). A study of 2058 things. Journal.\n\nDoe, A. (2020). Another study here. Journal.",
    ]
    rows = P.parse_lists(spark.createDataFrame([(str(i), t) for i, t in enumerate(lists)], "doc_id string, text string")).orderBy("doc_id", "pos").collect()
    assert [r.year for r in rows] == [1998, 2001, 1984, 2007, 2008, 1996, 1997, 2019, 2020]


def test_section():
    doc = "Title\n\nSome text about references here.\n" * 5 + "\nReferences\n[1] A.\n[2] B.\n[3] C.\n[4] D.\n[5] E.\n[6] F.\nAppendix\nmore"
    assert P.locate_section(doc).endswith("[6] F.") and P.locate_section(doc).startswith("[1] A.")
    assert P.locate_section("nothing") == "nothing"


def test_formats(spark):
    bib = '% note\n@article{k, title = {{Deep} nets}, author = {Last, First and Other, A.}, journal = "J", year = {2017}, doi = {10.1/x}}\n@comment{z, a = {b}}'
    [r] = formats.parse_bibtex(spark.createDataFrame([("d", bib)], "doc_id string, text string")).collect()
    assert (r.title, r.authors, r.year, r.venue, r.doi) == ("Deep nets", ["Last, First", "Other, A."], 2017, "J", "10.1/x")
    tei = '<x xmlns="http://www.tei-c.org/ns/1.0"><biblStruct><analytic><title level="a">T1</title><author><persName><forename>A</forename><surname>B</surname></persName></author></analytic><monogr><title level="j">J</title><imprint><date when="2001-02"/></imprint></monogr></biblStruct></x>'
    [r] = formats.parse_tei(spark.createDataFrame([("d", tei)], "doc_id string, text string")).collect()
    assert (r.title, r.authors, r.year) == ("T1", ["B, A"], 2001)
    for text, form in (("10.1000/a\n10.1000/b", "doi_list"), ("@book{x,", "bibtex"), ("TY  - JOUR", "ris"), ("PMID- 1", "nbib"), ('[\n{"title": "x"}]', "csl_json"), ("Some text", "plaintext")):
        assert one(spark, text, formats.sniff) == form


def test_catalog_mappers(spark):
    payload = lambda s: spark.createDataFrame([(s,)], "payload string")
    [r] = G.from_dblp(payload('{"info": {"title": "T", "year": "2020", "doi": "10.1/a", "venue": "V", "authors": {"author": [{"text": "A B"}, {"text": "C D"}]}}}')).collect()
    assert (r.title, r.authors, r.year) == ("T", ["A B", "C D"], 2020)
    [r] = G.from_google_books(payload('{"id": "g", "volumeInfo": {"title": "T", "authors": ["A"], "publishedDate": "1999-01", "publisher": "P", "industryIdentifiers": [{"type": "ISBN_13", "identifier": "978"}]}}')).collect()
    assert (r.isbn, r.doi, r.year) == ("978", None, 1999)
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/p</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"
    [r] = G.from_pubmed(payload(xml)).collect()
    assert (r.title, r.authors, r.year, r.doi, r.pmid) == ("T", ["F L"], 2001, "10.1/p", "7")
    atom = "<entry><id>http://arxiv.org/abs/2001.00001v2</id><title>A\n  B</title><published>2020-01-01T00:00:00Z</published><author><name>X Y</name></author></entry>"
    [r] = G.from_arxiv(payload(atom)).collect()
    assert (r.title, r.arxiv_id, r.year, r.authors, r.venue) == ("A B", "2001.00001", 2020, ["X Y"], "arXiv")
    refs = conform(spark.createDataFrame([("r", "10.1/X")], "ref_id string, doi string"), REFS)
    assert G.open_access(refs, payload('{"doi": "10.1/x", "best_oa_location": {"url": "http://u"}}')).first().oa_url == "http://u"


def test_model_answers(spark):
    refs = conform(spark.createDataFrame([("a", "some raw text", None), ("b", "x", "Known")], "ref_id string, raw string, title string"), REFS)
    assert [r.ref_id for r in P.recovery_prompts(refs).collect()] == ["a"]
    answers = spark.createDataFrame([("a", '```json\n{"title": "Found", "year": "2001"}\n```'), ("b", '{"title": "Other"}')], "ref_id string, response string")
    got = {r.ref_id: (r.title, r.year) for r in P.merge_recovered(refs, answers).collect()}
    assert got == {"a": ("Found", 2001), "b": ("Known", None)}


def test_verdict_precedence(spark):
    schema = "title string, doi string, authors array<string>, arxiv_id string, existence struct<status: string, mismatches: array<string>>, url_liveness struct<status: string>, relevance struct<status: string, label: string, rationale: string>"
    e, bad = ("PASS", []), ("WARN", ["year: cited=1, found=9"])
    rows = [
        (None, None, [], None, e, None, None), ("t", None, [], None, None, None, None), ("t", None, [], None, ("FAIL", []), ("FAIL",), None), ("t", None, [], None, bad, ("FAIL",), None),
        ("t", None, [], None, e, ("FAIL",), ("FAIL", "UNRELATED", "r")), ("t", None, [], None, e, ("PASS",), ("FAIL", "UNRELATED", "r")), ("t", None, [], None, ("WARN", []), ("WARN",), ("WARN", "PARTIAL", "r")),
    ]
    got = C.with_verdict(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert [r.verdict for r in got] == ["UNRESOLVABLE", "UNRESOLVABLE", "NOT_FOUND", "METADATA_MISMATCH", "DEAD_URL", "CONTENT_DRIFT", "VERIFIED"]
    assert len(got[3].notes) == 2 and got[5].notes == ["Content relevance check: UNRELATED. r"] and len(got[6].notes) == 2


def test_mismatching_identifiers(spark):
    rows = [("10.1/a", "10.1/A/"), ("/10.1/a/", "10.1/a"), ("10.1/a", "10.1/b"), (None, "10.1/b"), ("10.1/a", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    side = lambda c: F.struct(F.col(c).alias("doi"), F.lit(2001).alias("year"), F.array(F.lit("X, Y")).alias("authors")).alias(c + "s")
    got = [r.m for r in df.select(side("a"), side("b")).select(S.mismatches("as", "bs").alias("m")).collect()]
    assert got == [[], [], ["doi: cited=10.1/a, found=10.1/b"], [], []]
