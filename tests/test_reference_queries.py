"""Every query with SQL gives the SQL's rows at the smallest size."""

import os

import pytest

import __spark_entry__
from biblioforge.operators import title_index
from biblioforge.plans import format_queries, queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | format_queries.QUERIES, queries.ORACLES | format_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = sorted(ORACLES)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_like_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(df.columns)]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("frequent", [0, 3])
def test_title_search_with_frequent_tokens(spark, duck, monkeypatch, frequent):
    monkeypatch.setattr(title_index, "FREQUENT", frequent)
    test_like_sql(spark, duck, "j5_title_search")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["verdict", "references"]


def test_files_hold_twenty_works(spark):
    files = queries._rendered(spark, DATA, "concat(n)").collect()
    assert len(files) >= 9
    for f in files:
        numbers = [int(x) for x in f.text.split("\n")]
        assert len(numbers) <= 20 and {n // 20 for n in numbers} == {f.doc_id}


def test_every_document_is_mined(spark, monkeypatch):
    seen = []
    mine = queries.P.mine_documents
    monkeypatch.setattr(queries.P, "mine_documents", lambda docs: seen.append(docs) or mine(docs))
    queries.p19_mined_references(spark, DATA)
    want = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in seen[0].select("doc_id").collect()} == want and len(want) > 50
