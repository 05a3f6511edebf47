import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from biblioforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB, OWN = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
TEXTS = [
    "", "Hello  World's 123 it'll", "ΟΔΥΣΣΕΥΣ Σ ΑΣ", "İstanbul Straße É é", "<|endoftext|>a<|startoftext|> b<|ENDOFTEXT|>", "aaaaaaa aaaa" * 40,
    "\x1c\x1d\x85\xa0　x\ty", "日本語テキスト 🙂🙂 ½ ²", "a" * 3000 + "!" * 999, "'S 'T don'T", "​﻿᠎ z",
]


def check(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    [(a, b)] = OWN.encode_batch([text])
    assert a == " ".join(map(str, ids)), text
    assert b == LIB.decode(ids, skip_special_tokens=False) == bpe.decode(a, OWN)


def test_fixed_texts():
    for t in TEXTS:
        check(t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_like_the_library(text):
    check(text)


def test_query_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(3, TEXTS[3], "y"), (None, "z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0)).count() == 0
