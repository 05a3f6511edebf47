import random
from itertools import combinations

import pytest
import xxhash

from biblioforge.llm import near_copies, simhash


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def fp(text, seed):
    hs = [xxhash.xxh64_intdigest(w.encode(), seed) for w in set(words_of(text))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(texts, bits=5, similarity=0.8):
    """Group number of each text: equal texts, and pairs near by a fingerprint and alike by shingles."""
    fps = [[fp(t, s) for s in (42, 43)] for t in texts]
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        alike = union and 1000 * len(sets[i] & sets[j]) >= round(1000 * similarity) * union
        near = min((a ^ b).bit_count() for a, b in zip(fps[i], fps[j])) <= bits
        if ((texts[i] or "") == (texts[j] or "") or (near and alike)) and comp[i] != comp[j]:
            a, b = comp[i], comp[j]
            comp = [b if c == a else c for c in comp]
    return comp


def brute_kept(rows):
    """Places of the rows that stay."""
    comp = brute_groups([t for _, t in rows])
    return sorted(min(((rows[i][0] is None, rows[i][0] or 0, i) for i in range(len(rows)) if comp[i] == c))[2] for c in set(comp))


def corpus():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(700)]
    out = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "ONE  two\n"), (6, "x" * 50000), (7, "\xa0a b\x1fc É d"), (8, "five words are one shingle"), (9, "five words are one Shingle")]
    for i in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 400))]
        for k in range(5):
            edited = list(base)
            for _ in range(k * len(base) // 90):
                edited[rng.randrange(len(base))] = rng.choice(vocab)
            out.append((100 + i * 5 + k, " ".join(edited)))
    hub = [rng.choice(vocab) for _ in range(300)]
    for k in range(40):  # copies of one text, each edited elsewhere: alike to it, less so to each other
        edited = list(hub)
        for _ in range(5):
            edited[rng.randrange(300)] = "e%d" % k
        out.append((400 + k, " ".join(edited)))
    out.append((399, " ".join(hub)))
    rng.shuffle(out)
    out += [(900, out[20][1]), (901, out[20][1]), (900, out[20][1]), (None, "lonely null id"), (None, out[40][1])]
    return out


@pytest.mark.parametrize("block,short,members", [(4096, 64, 512), (7, 3, 4)])
def test_like_brute_force(spark, monkeypatch, block, short, members):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    data = corpus()
    df = spark.createDataFrame([(d, t, i, "a", 1) for i, (d, t) in enumerate(data)], "doc_id long, text string, row long, key string, fps long")
    out = near_copies.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.row for r in out.collect()) == brute_kept(data)
    assert len(brute_kept(data)) < len(data) - 60


def test_fingerprints_and_shingles():
    for _, t in corpus():
        assert [f & 0xFFFFFFFFFFFFFFFF for f in near_copies.fingerprints_of(t)] == [fp(t, 42), fp(t, 43)]
        assert len(near_copies.shingle_set(t)) == len(shingles(t))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, doc string")
    assert near_copies.keep_one(df).collect() == []
