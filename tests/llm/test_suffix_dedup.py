import hashlib
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from biblioforge.llm import suffix_dedup as S


def brute(texts, n):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + n] for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        kept = bytes(b for b, m in zip(r, mark) if not m)
        spans = sum(1 for i in range(len(r)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(r), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(n):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 9)))
    fresh = lambda k: " ".join(word() for _ in range(k))
    shared, other = fresh(n // 2), fresh(n // 3)
    out = [None, "", "a", "x" * (n - 1), "y" * n, "z" * (3 * n), "ab" * (2 * n), "é" * n]
    for i in range(60):
        t = fresh(rng.randrange(5, 200))
        if i % 3 == 0:
            t = t[: len(t) // 2] + shared + t[len(t) // 2 :]
        if i % 7 == 0:
            t += shared[: rng.randrange(len(shared))] + other
        out.append(t)
    out += [fresh(9000), out[12], out[12], out[20][:-3] + "qqq", out[9] + out[9], "the end"]
    return out


def run(spark, data, length, gram):
    rows = [(i // 2 if i % 5 else None, t, i, "s", "n") for i, t in enumerate(data)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, seg string, `__cut2` string")
    got = {r.key: r for r in S.remove_repeats(df, length, gram).collect()}
    assert len(got) == len(rows)
    return [tuple(got[i]["__cut"]) for i in range(len(rows))], [got[i].text for i in range(len(rows))]


def test_like_brute_force(spark):
    for length, gram in ((40, 12), (100, 64)):
        data = texts(length)
        cuts, kept = run(spark, data, length, gram)
        assert cuts == brute(data, length)
        assert kept[0] is None and kept[1] == "" and kept[2] == "a" and kept[-1] == "the end"


@pytest.mark.parametrize("memory", [64, 1000, 1 << 20])
def test_spill(memory):
    data = texts(40)
    segs = [(1, (t or "").encode()) for t in data]
    want = brute(data, 40)
    got = S.repeats_in(segs, 40, memory_bytes=memory)
    assert [(sum(b - a for a, b in g), len(g)) for g in got] == [(w[1], w[2]) for w in want]
    owners = [b"%d" % (i // 3) for i in range(len(segs))]
    seen = {}
    for (_, d), o in zip(segs, owners):
        for i in range(len(d) - 39):
            seen.setdefault(d[i : i + 40], set()).add(o)
    got = S.repeats_in(segs, 40, owners, memory)
    for (_, d), g in zip(segs, got):
        assert g == S.covered(np.array([i for i in range(len(d) - 39) if len(seen[d[i : i + 40]]) > 1], np.int64), 40)


@pytest.mark.parametrize("shard,hot", [(9000, 3), (9000, 10**6), (10**6, 5)])
def test_small_shards_and_hot_anchors(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    monkeypatch.setattr(S, "HOT_SEGMENTS", hot)
    data = texts(40)
    rng = random.Random(3)
    for i in range(60):  # a passage below the length, in different surroundings, some of them twice
        around = "".join(rng.choice("uvwxyz ") for _ in range(80))
        data += [around[:40] + "a hot passage of 30 characters" + around[40:]] * (1 + (i % 9 == 0))
    cuts, _ = run(spark, data, 40, 12)
    assert cuts == brute(data, 40)


def test_shard_larger_than_memory(spark):
    """A shard of 8 MB under 64 KB an array: files are used, memory is not, results are exact."""
    script = """
import re, threading, time
import numpy as np
from biblioforge.llm import suffix_dedup as S
rng = np.random.default_rng(1)
words = [bytes(rng.integers(97, 123, int(k), dtype=np.uint8)) for k in rng.integers(2, 9, 5000)]
shared = [b" ".join(words[i] for i in rng.integers(0, 5000, 90)) for _ in range(40)]
shard, raws = S.Shard(), []
for i in range(4000):
    parts = [b" ".join(words[j] for j in rng.integers(0, 5000, 340))]
    if i % 3 == 0:
        parts.insert(1, shared[i % 40])
    raws.append(b" ".join(parts))
    shard.add(0, i, 1, raws[-1])
own = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1])  # without mapped files
before, peak, going = own(), [0], [True]
def watch():
    while going[0]:
        peak[0] = max(peak[0], own())
        time.sleep(0.01)
(w := threading.Thread(target=watch)).start()
got = dict(shard.repeats(400, memory_bytes=64 << 10))
going[0] = False
w.join()
after = peak[0]
base = np.array([(j * 2654435761 + 12345) % (1 << 61) | 1 for j in range(256)], np.uint64)
hashes = []
for r in raws:  # an own rolling hash of every window
    x, p = base[np.frombuffer(r, np.uint8)], np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(x), p, np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(x * power)]
    back = np.cumprod(np.full(len(x), pow(int(p), -1, 1 << 64), np.uint64))
    hashes.append((total[400:] - total[:-400]) * back[: len(x) - 399] if len(x) >= 400 else x[:0])
every, n = np.unique(np.concatenate(hashes), return_counts=True)
twice = every[n > 1]
for i, h in enumerate(hashes):
    assert got.get(i, []) == S.covered(np.flatnonzero(np.isin(h, twice)), 400), i
assert len(got) > 1000 and shard.size > 8 << 20 and shard.spilled > 100 << 20
print("grew", (after - before) >> 10, "MB; in files", shard.spilled >> 20, "MB of", shard.size >> 20)
assert (after - before) >> 10 < 40
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True)
    assert done.returncode == 0, done.stdout + done.stderr
    print(done.stdout)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0


def test_planted_passages_of_the_contract_length(spark, tmp_path):
    """The query itself: passages of 400 bytes or more go from every holder, shorter ones stay
    however many words they have, so only the bytes decide and never the words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    at_bytes = lambda k: prose(k)[:k]
    passages = [at_bytes(k) for k in (300, 394, 398, 399, 400, 401, 650)]
    assert all(len(p.split()) > 45 for p in passages)
    data = [prose(150) for _ in range(40)]
    for i, p in enumerate(passages):  # each in three texts, between marks that differ
        data += [f"{prose(60)}{3 * i + k:03d}<{p}>{3 * i + k:03d}{prose(60)}".replace("<", "ABC"[k]).replace(">", "ABC"[k]) for k in range(3)]
    spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op6_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(data))] == brute(data, 400)
    assert [got[i][1] for i in range(len(data))] == [0] * 40 + [n for p in passages for n in [len(p) if len(p) >= 400 else 0] * 3]
