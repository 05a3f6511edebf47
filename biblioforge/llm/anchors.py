"""Content-chosen anchors: which stretches of bytes can hold a repeated string at all."""

from __future__ import annotations

import numpy as np

_TABLES = [np.random.default_rng(20240601 + i).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for i in range(2)]
_MIX = [np.uint64(x * 2 + 1) for x in np.random.default_rng(7).integers(1 << 60, 1 << 62, 64).tolist()]


def gram_hashes(data: np.ndarray, k: int, table: int = 0) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position, by doubling the width; of two kinds."""
    h, width, level = _TABLES[table][data], 1, 20 * table
    while width < k:
        step = min(width, k - width)
        h = h[:-step] * _MIX[level] + h[step:] if len(h) > step else h[:0]
        width, level = width + step, level + 1
    h ^= h >> np.uint64(31)
    h *= _MIX[40]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width < w:
        step = min(width, w - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    return h


def anchored_runs(data: np.ndarray, length: int, gram: int, barrier: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes, in runs that share their smallest gram hash.

    Equal windows have equal hashes, wherever they are, so two of them lie in runs of one
    key. Returns key, first window, last window of each run, and whether the run's gram
    returns inside it (only then can windows of one run be equal). Windows that hold the
    byte ``barrier`` are in no run.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    h = gram_hashes(data, gram)
    m = sliding_min(h, length - gram + 1)
    new = m[1:] != m[:-1]
    if barrier is not None:
        before = np.r_[0, np.cumsum(data == barrier)]
        whole = before[length:] == before[:-length]
        new |= whole[1:] != whole[:-1]
    change = np.flatnonzero(new)
    first, last = np.r_[0, change + 1], np.r_[change, len(m) - 1]
    again = np.flatnonzero((h[: len(m) - 1] == m[:-1]) & (m[1:] == m[:-1]))
    returns = np.zeros(len(first), bool)
    returns[np.searchsorted(first, again, "right") - 1] = True
    if barrier is not None:
        first, last, returns = first[whole[first]], last[whole[first]], returns[whole[first]]
    return m[first], first, last, returns
