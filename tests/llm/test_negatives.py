import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioforge.llm import negatives as N


def brute(rows, positives=5, negatives=10):
    v = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            label = (label + 1) % 10 if i % 7 == 0 else label
            y = np.floor(np.array(x, np.float64) * 256).astype(np.int64)
            v[i] = min(v.get(i, (label, y)), (label, y), key=lambda t: (t[0], t[1].tobytes()))
    width = max(len(y) for _, y in v.values())
    v = {i: (label, np.r_[y, np.zeros(width - len(y), np.int64)]) for i, (label, y) in v.items()}
    out = []
    for a, (label, x) in v.items():
        if a % 100 == 0:
            scores = sorted((-int(x @ y), i) for i, (_, y) in v.items() if i != a)
            for p, i in [(-s, i) for s, i in scores if v[i][0] == label][:positives]:
                hard = [(-s, j) for s, j in scores if v[j][0] != label and 30 * p <= -100 * s <= 90 * p][:negatives]
                out += [(a, i, r + 1, j, p, s) for r, (s, j) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "block"), [(2048, 8192), (2, 100)])
def test_like_brute_force(spark, monkeypatch, anchors, block):
    monkeypatch.setattr(N, "ANCHOR_BLOCK", anchors)
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(10, 20))
    rows = [(i, int(rng.choice(10, p=[0.4, *[0.6 / 9] * 9])), None) for i in range(800)]
    rows = [(i, k, [float(c) for c in centers[k] + rng.normal(size=20) * 1.5]) for i, k, _ in rows]
    rows += [(1000 + i, i % 3, rows[100][2]) for i in range(60)]  # equal vectors: ties by id
    rows += [(2000, None, [1.0] * 20), (2100, 1, None), (2200, 1, [None] * 20), (2300, 1, [float("inf")] * 20), (None, 1, [1.0] * 20), (2400, 1, []), (2500, 2, [0.5] * 5), (2600, 77, [1.0] * 20), (100, rows[100][1], rows[100][2])]
    df = spark.createDataFrame([(i, k, x, 1, "a", 3) for i, k, x in rows], "vec_id long, label int, embedding array<double>, rank int, a string, n int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(tuple(r) for r in N.mine(N.labelled(df, label), F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows) and len(got) > 100


def test_empty_tables(spark):
    df = spark.createDataFrame([(100, 1, [1.0, 2.0]), (101, 1, [1.0, 2.0]), (102, 2, [0.5, 0.9])], "vec_id long, label int, embedding array<float>")
    mine = lambda t: [tuple(r) for r in N.mine(N.labelled(t, F.col("label")), F.col("vec_id") % 100 == 0).collect()]
    # products: 256 * 256 * 5 with the positive; 256 * (128 + 2 * 230) with the negative
    assert mine(df) == [(100, 101, 1, 102, 327680, 150528)]
    assert mine(df.limit(0)) == [] and mine(df.limit(1)) == [] and mine(df.where("vec_id > 100")) == []


@pytest.mark.parametrize("width", [64, 192])
@pytest.mark.parametrize("planes", [2, 8])
def test_intervals_hold_every_product(width, planes):
    rng = np.random.default_rng(width + planes)
    v = np.floor(rng.normal(size=(500, width)) * rng.choice([1, 40, 3000], size=(500, 1))).astype(np.int64)
    v[0] = 0
    v[1] = v[2]
    v[3, :-1] = 0
    codes, along, rest = N.encode(v)
    low, high = N.intervals(v[:40], codes, along, rest, planes)
    exact = v[:40] @ v.T
    assert (low <= exact).all() and (exact <= high).all()


def test_few_survive():
    """Of unit vectors without any structure, a few in a hundred have to be scored."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(8192, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    labels = rng.integers(0, 10, len(v))
    low, high = N.intervals(v[:20], *N.encode(v))
    left = 0
    for i in range(20):
        s = v @ v[i]
        best = np.sort(s[(labels == labels[i]) & (np.arange(len(v)) != i)])[::-1][:5]
        left += len(N.survivors(labels[i], labels, low[i], high[i], [(-(-30 * int(p) // 100), 90 * int(p) // 100) for p in best], 10))
    print("share", left / 20 / len(v))
    assert left / 20 / len(v) < 0.05
