import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from biblioforge.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    rows = [(i, c) for i, t in docs if i is not None and (c := Counter(TERM.findall((t or "").translate(LOWER))))]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        scores = []
        for d, c in rows:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, a in Counter(TERM.findall(text.translate(LOWER))).items() if c[t])
            if s > 0:
                scores.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def texts(rng, n, vocabulary):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize(("shard", "block"), [(8192, 1024), (40, 3)])
def test_like_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(X, "SHARD_DOCS", shard)
    monkeypatch.setattr(X, "ITEM_BLOCK", block)
    rng = random.Random(4)
    vocabulary = ["the", "The", "ñandú", "ÑANDÚ", "x1", "日本", "a_b", "é"] * 4 + [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = list(enumerate(texts(rng, 300, vocabulary)))
    docs += [(400 + i, "the same text, the same rank") for i in range(60)] + [(500, None), (501, ""), (502, "\x00 --  "), (None, "the x1"), (7, "the x1 w1"), (503, "W1 " * 50000)]
    items = list(enumerate(texts(rng, 12, vocabulary))) + [(20, "same rank the the"), (21, None), (22, ""), (23, "unknown"), (20, "same rank the the"), (None, "the"), (3, "the")]
    d = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], "doc_id long, text string, n int, term string")
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    got = sorted(tuple(r) for r in X.ranked_search(d, q).collect())
    assert got == brute(docs, items, X.K)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert X.ranked_search(d.limit(0), q).count() == 0 and X.ranked_search(d, q.limit(0)).count() == 0
    # a term that all documents hold has weight 287, so even one document alone is found
    assert [tuple(r)[:3] for r in X.ranked_search(d, q).collect()] == [(1, 1, 1)]


def test_stops_early_and_right():
    """Few documents are scored where one list decides; equal scores at the end keep it going."""
    rng = np.random.default_rng(3)
    n = 5000
    doc = np.concatenate([np.arange(n), rng.permutation(n)[:1000]])
    term = np.repeat([0, 1], [n, 1000])
    gain = np.concatenate([rng.integers(1, 10**6, n), rng.integers(1, 1000, 1000)])
    lists = X.Lists(term, doc, gain)
    docs, scores, scored = X.best_positions(lists, np.array([0, 1]), np.array([3, 5]), 10)
    whole = np.zeros(n, np.int64)
    whole += 3 * gain[:n]
    whole[doc[n:]] += 5 * gain[n:]
    want = np.lexsort((np.arange(n), -whole))[:10]
    assert (docs == want).all() and (scores == whole[want]).all() and scored < n / 10
    flat = X.Lists(np.zeros(100, int), rng.permutation(100), np.full(100, 7))
    assert list(X.best_positions(flat, np.array([0]), np.array([1]), 10)[0]) == list(range(10))
