import numpy as np
from pyspark.sql import functions as F

from biblioforge.llm import topk


def brute(rows, k, scale=64):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            y = [int(np.floor(scale * c)) for c in x]
            v[i] = min(v.get(i, y), y)
    out = []
    for q in v:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], y)), i) for i, y in v.items() if i != q)[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)] + [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(3, rows[3][1]), (20, [9.0] * 6), (500, [1.0, 2.0]), (520, [])]
    df = spark.createDataFrame([(i, x, i, 7) for i, x in rows], "vec_id long, embedding array<double>, score long, q int")
    for blocks in ((2048, 8192), (7, 50)):
        monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
        got = sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0).collect())
        assert got == brute(rows, 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_happens():
    rng = np.random.default_rng(1)
    c = np.repeat(rng.normal(size=(40, 5)) * 100, 60, axis=0) + rng.normal(size=(2400, 5))
    p = np.floor(c).astype(np.int64)
    ids, s = topk.dual_tree(np.arange(50), p[:50], np.arange(2400), p, 5)
    full = p[:50] @ p.T
    full[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    assert (np.sort(full, axis=1)[:, ::-1][:, :5] == s).all()


def test_cells_are_pruned(spark, monkeypatch):
    """Vectors around few directions: a query meets few cells besides its own, and the result is exact."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 16)) * 8
    rows = [(i, [float(c) for c in centers[i % 12] + rng.normal(size=16) * 0.3]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs, inner = [], topk._other_cells

    def counted(chosen, radius):
        run, cells = inner(chosen, radius), len(radius)
        pairs.append((run, cells))
        return run

    monkeypatch.setattr(topk, "_other_cells", counted)
    got = sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, 20)
    run, cells = pairs[0]
    # what the bound lets through, of queries with their true k-th scores
    import pyarrow as pa

    worst = {q: s for q, r, _, s in got if r == 20}
    x = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    asked = pa.RecordBatch.from_arrays([pa.array(list(worst)), pa.array([x[q] for q in worst]), pa.array([-1] * len(worst), pa.int32()), pa.array([0] * len(worst), pa.int32()), pa.array(list(worst.values()))], names=["vec_id", "x", "cell", "q", "least"])
    met = run(asked).num_rows
    print("cells met", met / len(worst), "of", cells)
    assert met < 0.5 * cells * len(worst)
