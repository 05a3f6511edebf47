"""Stored title indexes and results, large files, dumps, macros and registered sources on small rows."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from biblioforge.operators import cache as K
from biblioforge.operators import key_index as X
from biblioforge.operators import matching as M
from biblioforge.operators import title_index as I
from biblioforge.plans.verify import Options, verify, verify_incremental
from biblioforge.schemas import CATALOG, FETCH_LOG, MODEL_ANSWERS, PAGES_TEXT, REFS, Source, conform, sources
from biblioforge.sources import catalog as G
from biblioforge.sources import formats, large

WORK = "work_id string, source string, title string, year int, authors array<string>, doi string, urls array<string>"
REF = "ref_id string, doc_id string, pos int, title string, year int, authors array<string>, doi string, urls array<string>"


def titles(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(n)]


def works(spark, rng, n, words):
    rows = [(f"w{i:04d}", rng.choice(["Crossref", "OpenAlex"]), t, 2000 + i % 2, ["A, B."], None, []) for i, t in enumerate(titles(rng, n, words))]
    return conform(spark.createDataFrame(rows, WORK), CATALOG)


def refs_of(spark, rng, n, words):
    rows = [(f"r{i:04d}", "d", i, t, rng.choice([2000, 2001, None]), ["A, B."], None, []) for i, t in enumerate(titles(rng, n, words))]
    return conform(spark.createDataFrame(rows, REF), REFS)


def test_index_is_read_without_a_shuffle(spark, tmp_path, capsys):
    rng = random.Random(1)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(300)]
    index = I.build_index(works(spark, rng, 300, words), str(tmp_path / "index"), frequent=5)
    again = I.open_index(spark, str(tmp_path / "index"))
    assert again == index and again.depth > 0
    asked = spark.range(50).select((F.col("id") * 7).alias("key")).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked.join(again.table(spark, "keys"), "key").explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    again.drop(spark)
    assert not os.path.exists(tmp_path / "index")


def test_stored_keys_need_no_shuffle_of_the_catalog(spark, tmp_path, capsys):
    rows = [("w1", "Crossref", "A", 2000, [], "10.1/A", ["http://x/"]), ("w2", "Nobody's", "A", 2000, [], "10.1/a/", ["http://x/"]), ("w3", "OpenAlex", "B", 2000, [], None, ["http://y/"]), ("w0", "Crossref", "C", 2000, [], "10.1/a", [])]
    catalog = conform(spark.createDataFrame(rows, WORK), CATALOG).withColumn("source_priority", F.when(F.col("source") == "OpenAlex", 2))
    refs = conform(spark.createDataFrame([("r1", "d", 1, "A", 2000, [], "10.1/a", []), ("r2", "d", 2, "B", 2000, [], None, ["http://x/", "http://y/"])], REF), REFS)
    keys = X.build_keys(catalog, str(tmp_path / "keys"))
    assert X.open_keys(spark, str(tmp_path / "keys")) == keys
    hits = lambda k: sorted(tuple(r) for r in M.lookup_doi(refs, catalog, "core", k).unionByName(M.lookup_url(refs, catalog, k)).collect())
    assert hits(keys) == hits(None) == [("r1", "w0", "Crossref", "doi", 1), ("r2", "w3", "OpenAlex", "url", 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        refs.selectExpr("lower(doi) AS key").repartition(3).join(keys.keys(spark, "doi").where("source = 'Crossref'"), "key").explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    keys.drop(spark)


@pytest.mark.parametrize("frequent", [1, 4, 1000])
def test_long_keys_lose_nothing(spark, frequent):
    """Few words, so that keys of several tokens are frequent too; against all pairs."""
    rng = random.Random(frequent)
    words = [f"t{int(rng.paretovariate(1.1))}" for _ in range(60)]
    catalog, refs = works(spark, rng, 150, words), refs_of(spark, rng, 60, words)
    index = I.build_index(catalog, frequent=frequent)
    assert index.depth > 1 or frequent == 1000
    got = sorted((r.ref_id, r.source, r.rank, r.work_id) for r in I.search_index(refs, index, F.array(*map(F.lit, sources("core")))).collect())
    index.drop(spark)
    import math

    c, q = catalog.collect(), refs.collect()
    want = []
    for source in ("Crossref", "OpenAlex"):
        mine = [(w.work_id, w.year, set(w.title.split())) for w in c if w.source == source]
        n, micro = len(mine), lambda x: round(math.log(1 + x) * 1e6)
        df = {}
        for _, _, t in mine:
            for x in t:
                df[x] = df.get(x, 0) + 1
        weigh = lambda t: sum(micro(n / df[x]) if x in df else micro(n) for x in t)
        for r in q:
            t, found = set(r.title.split()), []
            for w, year, x in mine:
                shared = weigh(t & x)
                if t & x and 2 * shared >= min(weigh(t), weigh(x)) and (source != "OpenAlex" or r.year in (None, year)):
                    found.append((-shared, w))
            want += [(r.ref_id, source, k + 1, w) for k, (_, w) in enumerate(sorted(found)[:5])]
    assert got == sorted(want)


def test_store_rewrites_touched_slices_only(spark, tmp_path):
    store, day = K.Store(str(tmp_path / "results"), 8), lambda d: datetime(2024, 1, d)
    rows = lambda ids, status, when: spark.createDataFrame([("existence", i, status, 0.5, "e", when) for i in ids], "namespace string, identifier string, status string, confidence double, evidence string, created_at timestamp").withColumn("key", K.key(F.lit("existence"), F.col("identifier")))
    assert store.merge(rows([str(i) for i in range(60)], "PASS", day(1))) == 8
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(store.path) for f in fs if f.endswith(".parquet")}
    before = files()
    assert store.merge(rows(["3", "new"], "FAIL", day(2))) in (1, 2)
    assert 0 < len(before - files()) <= 2
    held = {r.identifier: r.status for r in store.read(spark).collect()}
    assert len(held) == 61 and held["3"] == held["new"] == "FAIL" and held["4"] == "PASS"
    wanted = spark.createDataFrame([(x,) for x in ("3", "4", "none")], "identifier string").withColumn("key", K.key(F.lit("existence"), F.col("identifier")))
    hit, miss = store.lookup(wanted, F.lit(day(5)))
    assert [r.identifier for r in hit.collect()] == ["4"] and sorted(r.identifier for r in miss.collect()) == ["3", "none"]
    assert store.purge(spark, F.lit(day(5))) in (1, 2)
    assert store.read(spark).count() == 59
    assert store.purge(spark, F.lit(datetime(2025, 1, 1))) == 8 and store.read(spark).count() == 0 and store.merge(rows(["x"], "PASS", day(9))) == 1


def test_incremental_runs(spark, tmp_path, monkeypatch):
    catalog = conform(spark.createDataFrame([("w1", "Crossref", "Attention is all you need", 2017, ["Vaswani, A."], "10.1/att", [])], WORK), CATALOG)
    rows = [
        ("r1", "d", 1, "Attention is all you need", 2017, ["Vaswani, A."], "10.1/att", ["http://a/"]), ("r2", "d", 2, "Attention is all you need", 2017, ["Vaswani, A."], "10.1/att", []),
        ("r3", "d", 3, "No such thing anywhere", 2001, [], None, ["http://b/"]), ("r4", "d", 4, None, None, [], None, []),
    ]
    refs = conform(spark.createDataFrame(rows, REF), REFS)
    log = conform(spark.createDataFrame([("http://a/", 200), ("http://b/", 404)], "url string, status_code int"), FETCH_LOG)
    pages = conform(spark.createDataFrame([("http://a/", 200, "attention"), ("http://b/", 200, "b")], "url string, status_code int, text string"), PAGES_TEXT)
    answers = conform(spark.createDataFrame([("r1", '{"label": "RELEVANT", "confidence": 0.9}'), ("r3", "{}")], "ref_id string, response string"), MODEL_ANSWERS)
    store, opts = K.Store(str(tmp_path / "results"), 4), Options(check_relevance=True)
    run = lambda when, r=refs: verify_incremental(r, catalog, store, F.lit(when), log, pages, answers, opts)
    first = run(datetime(2024, 1, 1))
    # r2 shares r1's identity; r4 has none
    assert (first.references, first.links, first.answers) == (3, 2, 2)
    whole = {r.ref_id: (r.verdict, list(r.notes), r.existence.status, r.existence.work_id) for r in verify(refs, catalog, log, pages, answers, opts).collect()}
    said = {r.ref_id: (r.verdict, list(r.notes), r.existence.status, r.existence.work_id) for r in first.reports.collect()}
    assert {k: v for k, v in said.items() if k != "r2"} == {k: v for k, v in whole.items() if k != "r2"} and said["r2"][0] == "VERIFIED"
    scored = []
    monkeypatch.setattr("biblioforge.plans.verify.scored_cascade", lambda r, *a: scored.append(r.count()) or M.scored_cascade(r, *a))
    second = run(datetime(2024, 1, 1, 12), refs.where("ref_id <> 'r4'"))
    assert (second.references, second.links, second.answers, second.slices) == (0, 0, 0, 0) and scored == []
    assert {r.ref_id: (r.verdict, list(r.notes), r.existence.status, r.existence.work_id) for r in second.reports.collect()} == {k: v for k, v in said.items() if k != "r4"}
    third = run(datetime(2024, 1, 3))  # what failed has expired, and r4 is never stored
    assert (third.references, third.links) == (2, 1) and scored == [2]


BIB = """@string{pre = "Journal of "}
@article{k%d, title = {Title %d {B}}, note = {a
@home b}, journal = pre # {X}, year = 2001}
  @misc{m%d, title="Other %d", doi={10.1000/%d}}
"""


@pytest.mark.parametrize("kind", ["ris", "nbib", "bibtex", "doi_list"])
def test_large_file_like_a_small_one(spark, tmp_path, kind):
    n = 4000
    one = {
        "ris": lambda i: f"TY  - JOUR\r\nTI  - Title {i}\r\nAU  - É, {i}\r\nPY  - {i % 90 + 1900}\r\nER  - \r\n", "nbib": lambda i: f"PMID- {i}\nTI  - Title {i}\n      goes on\nDP  - 2001 Jan\nLID - 10.1000/{i} [doi]\n\n",
        "bibtex": lambda i: BIB % (i, i, i, i, i), "doi_list": lambda i: f"see 10.1000/{i}.\n",
    }[kind]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_bytes("".join(map(one, range(n))).encode() + b"10.1000/\xff\n" * (kind == "doi_list"))
    path = str(tmp_path / "f")
    small = formats.PARSERS[kind](formats.read_files(spark, path, kind).select(F.col("path").alias("doc_id"), "text"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        split = large.parse_split(spark, path, kind)
        whole = large.parse_path(spark, path, kind, whole_bytes=1000)
        split, whole = split.collect(), whole.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = lambda rows: sorted((r.title or "", tuple(r.authors), r.year or 0, r.venue or "", r.doi or "", r.pmid or "", r.raw if kind == "doi_list" else "") for r in rows)
    want = small.collect()
    assert plain(split) == plain(whole) == plain(want) and len(split) >= n
    assert len({r.ref_id for r in split}) == len(split)
    order = lambda rows: [r.title or r.doi for r in sorted(rows, key=lambda r: r.pos) if kind != "bibtex" or "Title" in r.title]
    assert order(split) == order(want)


def test_kinds_of_large_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - A\nER  - \n" * 40)
    (tmp_path / "b").write_text("PMID- 1\nTI  - B\n\n" * 60)
    (tmp_path / "c.txt").write_text("10.1000/c\n")
    (tmp_path / "d.json").write_text("[" + ",".join(['{"title": "D"}'] * 60) + "]")
    rows = large.parse_path(spark, str(tmp_path), whole_bytes=500).groupBy(F.coalesce("title", "doi").alias("t")).count().collect()
    assert {r.t: r["count"] for r in rows} == {"A": 40, "B": 60, "10.1000/c": 1, "D": 60}


def test_dumps_with_broken_records(spark, tmp_path):
    entry = "<entry><id>http://arxiv.org/abs/2301.%05dv1</id><title>T %d</title><published>2020-01-01</published></entry>\n"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text("<?xml version='1.0'?>\n<feed>" + "".join(entry % (i, i) + "<entry><title>a & b</title></entry><entry/>" * (i == 7) for i in range(30)) + "<entry><title>cut off</feed>")
    works_, read = large.catalog_of_dump(spark, str(tmp_path / "x"), "arXiv")
    assert sorted(r.title for r in works_.where("title IS NOT NULL").collect()) == sorted(f"T {i}" for i in range(30))
    assert [tuple(r) for r in large.broken(read).collect()] == [(32, 2)]
    for date, lines in (("2024-01-01", ['{"DOI": "10.1/a", "title": ["Old"]}', '{"DOI": "10.1/b", "title": ["B"]}', "{broken"]), ("2024-02-01", ['{"DOI": "10.1/a", "title": ["New"]}'])):
        (tmp_path / "j" / f"date={date}").mkdir(parents=True)
        (tmp_path / "j" / f"date={date}" / "a.json").write_text("\n".join(lines))
    works_, read = large.catalog_of_dump(spark, str(tmp_path / "j"), "Crossref")
    assert sorted((r.doi, r.title) for r in works_.collect()) == [("10.1/a", "New"), ("10.1/b", "B")]
    assert sorted((str(r.date), r.records, r.broken) for r in large.broken(read, "date").collect()) == [("2024-01-01", 3, 1), ("2024-02-01", 1, 0)]
    tei = '<biblStruct><analytic><title level="a">%s</title></analytic><monogr><imprint><date when="2001-02"/></imprint></monogr></biblStruct>'
    (tmp_path / "t.tei").write_text("<listBibl>" + tei % "One" + "<biblStruct><analytic></biblStruct>" + tei % "Two" + "</listBibl>")
    refs, read = large.refs_of_tei(spark, str(tmp_path / "t.tei"))
    assert sorted((r.title, r.year) for r in refs.collect()) == [("One", 2001), ("Two", 2001)] and large.broken(read).first().broken == 1


def test_macros(spark):
    text = '@string{b = a # " two" # c}\n@string{a = {one}}\n@string{c = c # {x}}\n@STRING(d = b)\n@article{k, title = b, journal = d # " " # jan, publisher = e, year = 20 # 01, author = "A and B"}\n@comment{x}\n@preamble{"y"}'
    other = "@article{k, title = a, journal = {kept # as is}}"
    rows = {r.doc_id: r for r in formats.parse_bibtex(spark.createDataFrame([("1", text), ("2", other), ("3", None), ("4", "")], "doc_id string, text string")).collect()}
    assert set(rows) == {"1", "2"}
    # a macro that leads back to itself stays a name; another file's macros are not known
    assert rows["1"].title == "one twoc"
    assert rows["1"].venue.endswith(" January") and rows["1"].year == 2001 and rows["1"].authors == ["A", "B"]
    assert rows["2"].title == "a" and rows["2"].venue == "kept # as is"


def test_registered_source_in_every_tier(spark):
    shape = lambda rows: G.catalog_rows(rows, "Local", F.col("id"), title=F.col("title"), doi=F.col("doi"), year=F.col("year"))
    payload = spark.createDataFrame([("1", "Attention is all you need", "10.1/att", 2017), ("2", "Only here indeed", None, 1999)], "id string, title string, doi string, year int")
    G.register("Local", shape, Source(0, "core", ("doi",), "year"))
    try:
        assert sources()[0] == "Local" and "Local" in sources("core", "doi") and "Local" not in sources("core", "arxiv_id")
        base = conform(spark.createDataFrame([("w1", "Crossref", "Attention is all you need", 2017, ["V, A."], "10.1/att", []), ("w2", "Nobody's", "Attention is all you need", 2017, ["V, A."], "10.1/att", [])], WORK), CATALOG)
        catalog = base.unionByName(G.union_catalog({"Local": payload}))
        refs = conform(spark.createDataFrame([("r1", "d", 1, "Attention is all you need", 2017, [], "10.1/att", []), ("r2", "d", 2, "Only here indeed", 1999, [], None, []), ("r3", "d", 3, "Only here indeed", 2005, [], None, [])], REF), REFS)
        scored = M.scored_cascade(refs, catalog)
        assert {(r.ref_id, r.work_id) for r in M.best_hits(scored).collect()} == {("r1", "Local:1"), ("r2", "Local:2")}
    finally:
        G.unregister("Local")
    assert "Local" not in sources()
