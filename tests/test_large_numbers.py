"""Documents numbered beyond 300,000, where derived arXiv ids come again on other works: still the SQL's rows."""

import os
import shutil
import time

import pytest

from biblioforge import storage
from biblioforge.operators import title_index
from biblioforge.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(spark, duck, folder, name):
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cur = duck.execute(queries.ORACLES[name])
    order = [[d[0] for d in cur.description].index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    return sorted(map(repr, got)), sorted(map(repr, want))


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """The smallest tables, each document and label once more 300,000 further on. Texts there are the next but
    two's, or begin with three more words: so other works of an arXiv id are alike to any degree."""
    duckdb = pytest.importorskip("duckdb")
    con, folder = duckdb.connect(), str(tmp_path_factory.mktemp("large"))
    for f in os.listdir(DATA):
        if f not in ("documents.parquet", "labels.parquet"):
            shutil.copyfile(f"{DATA}/{f}", f"{folder}/{f}")
    d, n = f"'{DATA}/documents.parquet'", "(SELECT count(*) FROM d)"
    con.execute(f"COPY (WITH d AS (SELECT * FROM {d}) SELECT * FROM d UNION ALL SELECT a.doc_id + 300000, CASE WHEN a.doc_id % 8 = 3 THEN ['Qxab zjkl vwqr ', 'Qxabc zjklm vwqrs ', 'Qxabc zjklmn vwqrstu '][a.doc_id % 3 + 1] || a.text ELSE b.text END, b.lang, b.source, b.n_chars FROM d a JOIN d b ON b.doc_id = (a.doc_id + 3) % {n}) TO '{folder}/documents.parquet'")
    labels = f"'{DATA}/labels.parquet'"
    con.execute(f"COPY (SELECT * FROM {labels} UNION ALL SELECT * REPLACE (doc_id + 300000 AS doc_id) FROM {labels}) TO '{folder}/labels.parquet'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con, folder


@pytest.mark.parametrize("name", ["a1_summary_by_document", "c12_enriched", "c13_incremental_reports", "c13_incremental_work", "c9_exact_verdicts", "c9_relevance_verdicts", "s19_markdown"])
def test_like_sql(spark, large, name):
    got, want = rows_of(spark, *large, name)
    assert got == want and len(want) > 2


def test_arxiv_ids_come_again(large):
    [(n,)] = large[0].execute(f"SELECT count(*) FROM (SELECT arxiv_id FROM {queries.CAT} WHERE arxiv_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT title) > 1)").fetchall()
    assert n > 10


def test_versions_with_title_search(spark, large):
    """With title search another version of an arXiv id does not pass by itself."""
    got, want = rows_of(spark, *large, "verdict_counts")
    assert got == want


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_title_search_in_slices(spark, monkeypatch, most):
    """Many slices of reference classes give the hits of one."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    monkeypatch.setattr(title_index, "PER_SLICE", most)
    got, want = rows_of(spark, con, DATA, "j5_title_search")
    assert got == want and len(want) > 300


def test_kept_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {f.getName() for f in [disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())]}
    kept = storage.keep(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        files = disk.getAllFiles()
        left = {files.apply(i).getName() for i in range(files.size())} - before
        if not any(n.startswith("shuffle_") for n in left):
            break
        time.sleep(0.2)
    assert not any(n.startswith("shuffle_") for n in left) and kept.count() == 1000
    assert spark.conf.get(storage.CLEANUP) == "false"
    storage.discard(kept)


def test_keys_hold_no_tokens(spark):
    """A class has many keys: they do not carry its tokens along."""
    works = spark.createDataFrame([(f"w{i}", "Crossref", f"one two three number{i % 7}", 2000, ["A, B."]) for i in range(40)], "work_id string, source string, title string, year int, authors array<string>")
    kept, real = [], title_index.keep
    title_index.keep = lambda df: kept.append(df.columns) or real(df)
    try:
        title_index.build_index(works, frequent=2).drop(spark)
    finally:
        title_index.keep = real
    assert any("key" in c for c in kept) and not any("key" in c and "known" in c for c in kept)
