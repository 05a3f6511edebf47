import re
from collections import Counter

from biblioforge.llm import quality as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


TEXTS = [
    None, "", " \t\n\x0b\f\r", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x\xa0y é\x85z", "l1\nl1\n\n \nl2\nl1", "# * $ % & | < >", "WORD " * 40,
    "the quick brown fox jumps over the lazy dog again and again until all of the twenty words are here now ok", "z " * 5000 + " ".join(map(str, range(3000))),
]


def test_like_brute_force(spark):
    data = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "x", 1), (None, TEXTS[4], "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, _t string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.apply_policy(Q.ledger(df)).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _, _ in data), key=str)
    assert Q.keep_good(df).columns == df.columns
    assert [r.doc_id for r in Q.keep_good(df).collect()] == [10]
    assert Q.apply_policy(Q.ledger(df.limit(0))).count() == 0


def test_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (4,), (4,), (64,)], "rule_bits long")
    got = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(rows).collect()}
    assert got["few_words"] == (2, 1) and got["repeated_windows"] == (1, 0) and got["symbols"] == (2, 2) and got["stutter"] == (0, 0)
    assert {r.rule_bits: r.kept for r in Q.apply_policy(rows, Q.Policy("none", 2, ())).collect()} == {0: True, 1: False, 3: False, 4: True, 64: True}
