import math

import numpy as np
from pyspark.sql import functions as F

from biblioforge.llm import neighbours as N


def brute(rows, k, every):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x):
            y = np.trim_zeros(np.array(x, np.float64), "b")
            v[i] = min(v.get(i, y), y, key=lambda z: z.tobytes())
    width = max(map(len, v.values()))
    m = {i: np.r_[x, np.zeros(width - len(x))] for i, x in v.items()}
    out = {}
    for q in m:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((m[q] - x) ** 2).sum())), i) for i, x in m.items() if i != q)[:k]
    return out


def test_recall_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 24))
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(base)]
    rows += [(2000 + i, rows[40][1]) for i in range(300)]  # copies: equal distances, smaller ids first
    rows += [(3000, None), (3020, []), (3040, [0.0] * 24), (3060, [float("nan")] * 24), (3080, [None, 1.0]), (None, [1.0] * 24), (4000, [9.0, 1.0]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, x, 1, "n", 2.0) for i, x in rows], "vec_id long, embedding array<double>, rank int, node string, score double")
    got = {}
    for r in N.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, 10, 20)
    assert set(got) == set(want)
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, 11))
        scored = [(s, i) for _, s, i in found]
        assert scored == sorted(scored) and q not in [i for _, i in scored]
        hit += len({i for _, i in scored} & {i for _, i in want[q]})
        total += 10
    assert hit >= 0.97 * total
    assert [i for _, _, i in got[2000]] == [i for _, i in want[2000]]  # all at distance zero
    assert all(abs(a[1] - b[0]) < 1e-12 for a, b in zip(got[2000], want[2000], strict=True))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in N.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]
    assert N.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert N.nearest(df.limit(1), F.col("vec_id") == 0).count() == 0
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'forge_graph%'").count() == 0


def test_other_queries_enter_anywhere(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(base)], "vec_id long, embedding array<double>")
    graph = N.build(N.usable_vectors(df, "vec_id", "embedding"))
    asked = rng.normal(size=(20, 8))
    queries = spark.createDataFrame([(-1 - i, bytearray(x.tobytes())) for i, x in enumerate(asked)], "query_id long, x binary")
    some = graph.nodes.select("node").orderBy(F.xxhash64("node")).limit(8)
    got = {}
    for r in N.search(graph, queries, queries.select("query_id").crossJoin(some)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    graph.drop()
    hit = sum(len(got[-1 - i] & set(np.argsort(((base - x) ** 2).sum(1))[:10])) for i, x in enumerate(asked))
    assert hit >= 0.97 * 200
