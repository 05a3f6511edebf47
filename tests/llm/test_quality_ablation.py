import os

import duckdb
import pytest

from biblioforge.llm import quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_like_sql(spark):
    got = quality.quality_ablation(spark, DATA)
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = duckdb.execute(quality.ORACLES["quality_ablation"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
    assert len(got.columns) == len(names)
