import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from biblioforge.llm import packing as P
from biblioforge.llm.common import materialize


def test_pieces_like_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [None, "", "a", "Hello <|endoftext|> wörld  \n\n x", "it's 123 日本 🙂", " ".join(rng.choice(["the", "Zürich", "x9", "\t"]) for _ in range(5000)), "y" * 7000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(1, "", 3), (None, "q", 3)], "doc_id long, text string, length int")
    out = P.pack(materialize(P.token_pieces(df))).collect()
    for d, t in [*enumerate(texts), (None, "q")]:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == d)
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(set(got)) == want
    assert P.pack(materialize(P.token_pieces(df.limit(0)))).count() == 0


def test_many_groups(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, min(2048, int(rng.lognormvariate(6, 1)) + 1), 0, i) for i in range(3000)]
    df = spark.createDataFrame(rows, P.PIECES)
    out = P.pack(materialize(df), group_pieces=30).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.02 * -(-sum(r[3] for r in rows) // 2048) + 2


def test_search_reaches_the_optimum_on_small_cases():
    rng = random.Random(6)
    for _ in range(6):
        n = np.array([rng.randrange(1, 11) for _ in range(7)])
        fits = (len(set(a)) for a in product(range(4), repeat=7) if all(n[[i for i in range(7) if a[i] == b]].sum() <= 12 for b in range(4)))
        best = min(fits, default=7)
        got = len(P.local_search(P.best_fit_decreasing(n, 12), n, 12))
        assert got <= best + 1 and got >= -(-n.sum() // 12)
