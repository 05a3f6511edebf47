import random

from pyspark.sql import functions as F

from biblioforge.llm import toxicity as T


def brute_segments(x):
    """Split off the best segment (leftmost, shortest), recurse on both sides."""

    def go(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += x[j]
                if s > 1e-12 and (best is None or s > best[2] + 1e-9):
                    best = (i, j, s)
        return [] if best is None else [*go(a, best[0]), best, *go(best[1] + 1, b)]

    return go(0, len(x))


def test_segments_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n, drift = rng.randrange(1, 40), -rng.choice([0.37, 1.13])
        x = [rng.choice([0.91, 2.17, 3.3]) if rng.random() < 0.35 else drift for _ in range(n)]
        got = T.maximal_segments([(i, v) for i, v in enumerate(x) if v > 0], drift)
        want = brute_segments(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def corpus(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["word%s" % "abcdefghij"[rng.randrange(10)] * 1 + rng.choice(["ly", "er", "ing"]) for _ in range(rng.randrange(5, 200))]
        y = int(i % 7 == 0)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "Scoundrels!", "vermin"]))
        rows.append((i, " ".join(words), i, 0.5))
        labels.append((i, y))
    return rows, labels


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    rows += [(1000, None, 0, 0.0), (1001, "", 0, 0.0), (None, "vermin " * 3, 0, 0.0), (0, rows[0][1], 0, 0.0), (1002, "worda " * 100000 + "vermin vermin vermin", 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long, score double")
    lab = spark.createDataFrame([*labels, (0, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(docs, lab)
    got = T.score_documents(docs, model).withColumn("held_out", T.held_out()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = dict(labels)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in test) / len(test) > 0.97
    assert by[1000].score < 0.5 and by[1001].score < 0.5 and by[None].score >= 0.5
    assert by[1002].passages[0].first == 100000 and by[1002].passages[-1].last == 100002


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score_documents(docs, T.fit(docs, none)).collect()] == [0.0, 0.0]
    assert T.score_documents(docs.limit(0), T.fit(docs, none)).count() == 0
    assert docs.select(T.held_out()).where(F.col("coalesce(((crc32(encode(CAST(doc_id AS STRING), UTF-8)) % 5) = 0), false)").isNull()).count() == 0
