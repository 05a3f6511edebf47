import random
import zlib
from collections import Counter

import numpy as np
from test_near_copies import brute_kept

import corpus_pipeline as P
from biblioforge.llm import packing


def brute_cut_texts(texts, n):
    """What stays of each text without the bytes of any n-byte string that starts twice."""
    seen = Counter()
    raws = [t.encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + n] for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        out.append(bytes(b for b, m in zip(r, mark) if not m).decode(errors="ignore"))
    return out


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, short, rows, labels = prose(90), prose(51), [], []
    for i in range(120):
        text = prose(rng.randrange(30, 250))
        if i % 9 == 0:
            text = text + " " + " ".join(["scoundrel vermin"] * 3)
        if i % 10 == 3:
            text = " ".join(w + "###" for w in text.split())
        if i % 8 == 5:
            text = text + " " + passage + " " + prose(40)
        if i % 8 == 6:
            text = prose(30) + " " + short + "\n" + text
        rows.append((i, text))
        labels.append((i, int(i % 9 == 0)))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " tail"), (1, rows[1][1]), (202, None), (203, ""), (204, prose(8000)), (205, "é" * 150 + " " + rows[4][1])]
    assert 200 < len(short) < 400
    return rows, labels


def test_like_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in P.run(spark, str(tmp_path)).collect())

    toxic = {d for d, y in labels if y}
    left = [(d, t) for d, t in rows if d not in toxic]
    left = [(d, t) for d, t in left if t and len(t.split()) >= 20 and "###" not in t]
    left = [left[i] for i in brute_kept(left)]
    cut = brute_cut_texts([t for _, t in left], P.PASSAGE)
    assert sum(a != b for (_, a), b in zip(left, cut)) > 8
    enc = packing._encoder(packing.default_ranks())
    want = []
    for (d, _), text in zip(left, cut, strict=True):
        ids = np.array([*enc.encode_ordinary(text), 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert [g[:5] for g in got] == sorted(want)
    fills = {}
    for _, _, _, n, _, s, o in got:
        fills.setdefault(s, []).append((o, n))
    for parts in fills.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_each_stage_on_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, doc string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, None, None, None, None, 1, "a", "b"), (1, "", None, None, 0, 1, "a", "b"), (1, "word " * 30, "en", "s", 150, 1, "a", "b")]
    for data in ([], odd):
        docs = spark.createDataFrame(data, schema)
        good = "word " * 30
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            texts = sorted((r.text or "", r.text is None) for r in out.collect())
            if data and name != "suffix_array_dedup":  # null and empty text are alike, and the row with an id stays
                want = {"toxicity": [None, "", good], "quality_rules": [], "simhash_near_dedup": ["", good]}[name]
                assert texts == sorted((t or "", t is None) for t in want), name
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(data)
