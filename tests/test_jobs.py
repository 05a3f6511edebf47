"""Files to references, cache rules, domain routing and a whole verification on small rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from biblioforge.operators import cache as K
from biblioforge.operators import checks as C
from biblioforge.operators import matching as M
from biblioforge.operators import summary as A
from biblioforge.plans.verify import Options, verify
from biblioforge.schemas import CATALOG, CHECK_CACHE, FETCH_LOG, REFS, conform
from biblioforge.sources import formats, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - A title\nAU  - X, Y\nPY  - 2001\nER  - \n")
    (tmp_path / "b.txt").write_bytes(b"10.1000/a\n10.1000/b.\n")
    (tmp_path / "c.json").write_text('[{"title": "J", "issued": {"date-parts": [[1999]]}}]')
    (tmp_path / "d.bib").write_bytes(b"@misc{k, title={T\xff}, url={http://arxiv.org/abs/1234.5678}}")
    files = formats.read_files(spark, str(tmp_path))
    assert {r.path[-5:]: r.format for r in files.collect()} == {"a.ris": "ris", "b.txt": "doi_list", ".json"[-5:]: "csl_json", "d.bib": "bibtex"}
    refs = formats.parse_files(files).collect()
    assert sorted((r.title or "", r.doi or "", r.year or 0) for r in refs) == [("", "10.1000/a", 0), ("", "10.1000/b", 0), ("A title", "", 2001), ("J", "", 1999), ("T�", "", 0)]
    [bib] = [r for r in refs if r.title and r.title[0] == "T"]
    assert bib.arxiv_id == "1234.5678" and bib.urls == []


def test_cache_rules(spark):
    now = datetime(2024, 2, 1)
    rows = [("existence", i, i, s, 0.5, "e", now - timedelta(days=d)) for i, s, d in (("a", "FAIL", 0.5), ("b", "FAIL", 2), ("c", "PASS", 29), ("d", "WARN", 31), ("a", "PASS", 3))]
    cache = spark.createDataFrame(rows, CHECK_CACHE)
    hit, miss = K.lookup(spark.createDataFrame([(x,) for x in "abcde"], "key string"), cache, F.lit(now))
    assert {r.key: r.status for r in hit.collect()} == {"a": "FAIL", "c": "PASS"} and sorted(r.key for r in miss.collect()) == ["b", "d", "e"]
    assert sorted(r.key for r in K.purge(cache, F.lit(now)).collect()) == ["a", "c"]
    assert K.upsert(cache, cache).count() == 4


def test_verification(spark):
    work = {"title": "Attention is all you need", "authors": ["Vaswani, A.", "Shazeer, N."], "year": 2017, "venue": "NeurIPS"}
    works = [("w1", "Crossref", 1, *work.values(), "10.1/att", None, []), ("w2", "PubMed", 5, "Gut flora in mice", ["Doe, J."], 2010, "Gut", None, "77", ["http://land/2"])]
    catalog = conform(spark.createDataFrame(works, "work_id string, source string, source_priority int, title string, authors array<string>, year int, venue string, doi string, pmid string, urls array<string>"), CATALOG)
    rows = [
        ("r1", work["title"], work["authors"], 2017, "10.1/ATT/", [], None), ("r2", work["title"], ["Other, X."], 2020, "10.1/att", [], None), ("r3", "Nothing like it at all", ["No, B."], 2099, None, [], None),
        ("r4", None, [], None, None, [], None), ("r5", work["title"], work["authors"], 2017, None, ["http://dead/"], None), ("r6", "Gut flora in mice", ["Doe, J."], 2010, None, [], "77"),
    ]
    refs = conform(spark.createDataFrame(rows, "ref_id string, title string, authors array<string>, year int, doi string, urls array<string>, pmid string"), REFS)
    log = conform(spark.createDataFrame([("http://dead/", 404)], "url string, status_code int"), FETCH_LOG)
    reports = verify(refs, catalog, log, opts=Options())
    got = {r.ref_id: r for r in reports.collect()}
    assert {k: r.verdict for k, r in got.items()} == {"r1": "VERIFIED", "r2": "METADATA_MISMATCH", "r3": "NOT_FOUND", "r4": "UNRESOLVABLE", "r5": "DEAD_URL", "r6": "VERIFIED"}
    assert got["r5"].enriched.doi == "10.1/att" and got["r3"].enriched is None and got["r3"].url_liveness is None
    assert "year: cited=2020, found=2017" in got["r2"].notes[0] and "cited=['Other, X.'], found=['Vaswani, A.', 'Shazeer, N.']" in got["r2"].notes[0]
    s = A.summary(reports).first()
    assert (s.total, s.verified, s.issues, s.skipped) == (6, 2, 3, 1) and A.gate(reports).first().failed
    text = {r.markdown.split("\n")[0]: r.markdown for r in sinks.markdown(reports).collect()}
    assert "could not verify" in text["## Nothing like it at all"]
    more = catalog.union(catalog.withColumn("work_id", F.lit("w9")).withColumn("title", F.lit("Attention")))
    best = {r.ref_id: r.existence.composite for r in C.check_existence(refs, more, M.scored_cascade(refs, more)).collect()}
    assert all(best[k] is None or got[k].existence.composite is None or best[k] >= got[k].existence.composite for k in best)
