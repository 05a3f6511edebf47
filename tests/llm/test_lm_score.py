import math
import random
import zlib
from collections import Counter

import pytest

from biblioforge.llm import lm_score as L


def brute(rows, good, size):
    """The same models with plain dictionaries."""
    freq = Counter(w for _, t in rows for w in (t or "").lower().split())
    known = [w for w, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0]))[:size]]
    number = {w: i for i, w in enumerate(known)}
    start = len(known) + L.CLASSES
    ids = lambda t: [number.get(w, len(known) + zlib.crc32(w.encode()) % L.CLASSES) for w in (t or "").lower().split()]
    models = []
    for keep in (lambda d: d in good, lambda d: True):
        one, pre, two = Counter(), Counter(), Counter()
        for d, t in rows:
            if keep(d):
                x = ids(t)
                for a, b in zip([start, *x], x):
                    one[b] += 1
                    pre[a] += 1
                    two[a, b] += 1
        models.append((one, pre, two, sum(one.values())))
    out = []
    for d, t in rows:
        x = ids(t)
        if not x:
            out.append((d, 0, None, None))
            continue
        loss = []
        for one, pre, two, n in models:
            p1 = lambda b: (one[b] + L.ALPHA) / (n + L.ALPHA * (start + 1))
            loss.append(-sum(math.log((two[a, b] + L.MU * p1(b)) / (pre[a] + L.MU)) for a, b in zip([start, *x], x)) / len(x))
        out.append((d, len(x), round(loss[0], 4), round(loss[1], 4)))
    return sorted(out, key=str)


def test_like_plain_dictionaries(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 40 + 1))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "w1 W2"), (3, rows[3][1]), (102, "rare " * 30000)]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, good string")
    good = spark.createDataFrame([(i,) for i in [*range(0, 60, 3), 3, 3, None]], "doc_id long")
    got = L.cross_entropy_difference(df, good, 12).collect()
    want = brute(rows, set(range(0, 60, 3)) | {3}, 12)
    assert sorted(((r.doc_id, r.n_tokens, None if r.loss_target is None else round(r.loss_target, 4), None if r.loss_background is None else round(r.loss_background, 4)) for r in got), key=str) == want
    assert all(r.score is None or abs(r.score - (r.loss_target - r.loss_background)) < 1e-9 for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert L.cross_entropy_difference(df, none).count() == 1
    assert L.cross_entropy_difference(df.limit(0), none).count() == 0


def exact(rows, good):
    """Both models over every word and bigram, with plain dictionaries."""
    models, size = [], len({w for _, t in rows for w in t.split()}) + 1
    for keep in (lambda d: d in good, lambda d: True):
        one, pre, two = Counter(), Counter(), Counter()
        for d, t in rows:
            if keep(d):
                x = t.split()
                one.update(x)
                pre.update([None, *x[:-1]])
                two.update(zip([None, *x], x))
        models.append((one, pre, two, sum(one.values())))
    out = {}
    for d, t in rows:
        x = t.split()
        out[d] = [
            -sum(math.log((two[a, b] + L.MU * (one[b] + L.ALPHA) / (n + L.ALPHA * size)) / (pre[a] + L.MU)) for a, b in zip([None, *x], x)) / len(x) for one, pre, two, n in models
        ]
    return out


@pytest.mark.parametrize("chunk,bucket,share", [(L.CHUNK, L.BUCKET_ROWS, L.HOT_SHARE), (3000, 20000, 2000), (3000, 20000, 20), (3000, 20000, 1)])
def test_counts_grow_with_the_corpus(spark, monkeypatch, chunk, bucket, share):
    for name, value in (("CHUNK", chunk), ("BUCKET_ROWS", bucket), ("HOT_SHARE", share)):
        monkeypatch.setattr(L, name, value)
    rng = random.Random(3)
    rows = [(i, " ".join("the same pair" if rng.random() < 0.2 else f"w{rng.randrange(70000)}" for _ in range(rng.randrange(1, 4000)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 150, 3)], "doc_id long")
    want = exact(rows, set(range(0, 150, 3)))
    got = {r.doc_id: r for r in L.cross_entropy_difference(df, good).collect()}
    assert len({w for _, t in rows for w in t.split()}) > 50_000
    assert set(got) == set(want)
    for d, (t, b) in want.items():
        assert abs(got[d].loss_target - t) < 1e-9 and abs(got[d].loss_background - b) < 1e-9
