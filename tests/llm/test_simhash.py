import random

import pytest
import xxhash

from biblioforge.llm import simhash


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    out = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "ONE  two\n"), (6, "x" * 50000), (7, "\xa0a b\x1fc É d")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(4):
            edited = list(base)
            for _ in range(k):
                edited[rng.randrange(300)] = rng.choice(words)
            out.append((100 + i * 4 + k, " ".join(edited)))
    out += [(900, out[20][1]), (901, out[20][1]), (900, out[20][1]), (None, "lonely null id")]
    return out


def run(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "2 AS component_id")
    got = simhash.near_duplicates(df).collect()
    return sorted(((r.doc_id, f"{r.fp & 0xFFFFFFFFFFFFFFFF:016x}", r.component_id) for r in got), key=str)


def test_matches_brute_force(spark):
    assert run(spark, rows()) == brute(rows())


@pytest.mark.parametrize("block,short", [(3, 2), (64, 2), (4096, 64)])
def test_blocks_of_long_lists(spark, monkeypatch, block, short):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    fps = [(1 << 40) + (i if i < 64 else i << 20) for i in range(128)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").distinct()
    from biblioforge.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.link_edges(df, 128)).collect()}
    distinct = sorted(set(fps))
    comp = {x: x for x in distinct}
    changed = True
    while changed:
        changed = False
        for x in distinct:
            for y in distinct:
                if (x ^ y).bit_count() <= 3 and comp[x] != comp[y]:
                    comp[x] = comp[y] = min(comp[x], comp[y])
                    changed = True
    assert {x: got.get(x, x) for x in distinct} == comp


def test_keys_cover_every_pair():
    from itertools import combinations

    for n, bits in ((1, 3), (1 << 40, 3), (1, 4), (1 << 40, 5), (1, 6)):
        keys = simhash.index_keys(n, bits)
        assert all(any(set(k) <= set(agree) for k in keys) for agree in combinations(range(8), 8 - bits))


def test_empty_table(spark):
    assert run(spark, []) == []
