import numpy as np
import pytest

from biblioforge.llm import induced
from biblioforge.llm.induced import suffix_array


def brute(t, cap):
    t = list(map(int, t))
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0] * len(t)
    for r in range(1, len(t)):
        a, b, n = sa[r - 1], sa[r], 0
        while n < cap and a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        lcp[r] = n
    return sa, lcp


@pytest.mark.parametrize("limit,base", [(1 << 30, 1 << 20), (1 << 30, 0), (64, 40), (64, 0), (1200, 30)])
def test_like_brute_force(limit, base, monkeypatch):
    monkeypatch.setattr(induced, "BASE", base)
    rng = np.random.default_rng(4)
    cases = [np.array(x) for x in ([], [5], [1, 1], [2, 1], [1, 2], [0] * 50, [1, 0] * 30, list(range(40)), list(range(40, 0, -1)))]
    for _ in range(150):
        n, k = int(rng.integers(2, 400)), int(rng.choice([1, 2, 3, 5, 250, 5000]))
        x = rng.integers(0, k + 1, n)
        if rng.random() < 0.5:
            x = np.concatenate([x, x[: n // 2], x, x[n // 3 :]])
        cases.append(x)
    for x in cases:
        for cap in (7, 400):
            sa, lcp = suffix_array(x, cap, limit)
            want = brute(x, cap)
            assert sa.tolist() == want[0]
            assert lcp.tolist() == want[1]
