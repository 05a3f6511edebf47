"""Suffix sorting by recursive induction, with common-prefix values, from disk.

One queue serves both induction passes: a monotone bucket priority queue whose tuples
(symbol, order of arrival, suffix, common prefix with the one before) lie bucket by bucket
in arrays that move to files once they outgrow ``MEMORY_BYTES``. Popping takes the longest
run of tuples that nothing still to be pushed can precede, so whole runs are induced with a
few array operations. Common-prefix values are carried along: those of the recursion's
names give those of the seeds, and a range minimum over the popped tuples gives those of
the pushed ones. Values stop counting at ``cap``.

Everything that is as long as the text lies in such arrays, texts, types and seeds too; the
rest of the work goes chunk by chunk, and seeds are named by a quicksort whose parts are
arrays of the store. So a text may be many times larger than memory. Files have no name from
the start: they vanish with the array or the process.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

#: Arrays larger than this lie in files of the task's own spill folder.
MEMORY_BYTES = 512 << 10
#: A recursion of this many names ends in prefix doubling.
BASE = 1 << 18


class Store:
    """Allocates arrays in memory or, when large, in unnamed files."""

    def __init__(self, limit: int):
        self.limit, self.chunk, self.spilled = limit, max(8, min(1 << 18, limit // 4)), 0

    def new(self, n: int, dtype, value: int = 0) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.limit:
            return np.full(n, value, dtype)
        with tempfile.TemporaryFile(prefix="suffix-spill-") as f:
            f.truncate(size)
            out = np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))
        self.spilled += size
        if value:
            out[:] = value
        return out

    def chunks(self, n: int, first: int = 0) -> Iterator[tuple[int, int]]:
        for a in range(first, n, self.chunk):
            yield a, min(n, a + self.chunk)


@contextmanager
def sorted_suffixes(text: np.ndarray, cap: int, s: Store):
    """Suffixes of an int32 array of non-negative numbers in order, and the length of the
    prefix that each shares with the one before it (at most ``cap``); in arrays of the store."""
    yield _sort(text, cap, s)


def suffix_array(text: np.ndarray, cap: int, memory_bytes: int = MEMORY_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The same, in memory."""
    with sorted_suffixes(np.ascontiguousarray(text, np.int32), cap, Store(memory_bytes)) as (sa, lcp):
        return np.array(sa), np.array(lcp)


def _add(counts: np.ndarray, at: np.ndarray) -> None:
    if len(counts) <= 4 * len(at):
        counts += np.bincount(at, minlength=len(counts))
    else:
        np.add.at(counts, at, 1)


def _types(t: np.ndarray, s: Store) -> tuple[np.ndarray, np.ndarray]:
    """From right to left: whether each suffix is smaller than the next one, and where its run
    of equal symbols ends."""
    n = len(t)
    small, ends = s.new(n, bool), s.new(n, np.int32)
    for a in range((n - 1) // s.chunk * s.chunk, -1, -s.chunk):
        b = min(n, a + s.chunk)
        x, y = t[a:b], t[a + 1 : b + 1]
        stop, rise = np.ones(b - a, bool), np.zeros(b - a, bool)
        stop[: len(y)], rise[: len(y)] = x[: len(y)] != y, x[: len(y)] < y
        e = np.minimum.accumulate(np.where(stop, np.arange(a, b), n)[::-1])[::-1]
        goes_on = e == n
        types = rise[np.minimum(e, b - 1) - a]
        if goes_on.any():
            e = np.where(goes_on, ends[b], e)
            types[goes_on] = small[b]
        small[a:b], ends[a:b] = types, e
    return small, ends


def _sort(t: np.ndarray, cap: int, s: Store, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32), np.zeros(n, np.int16)
    if n <= BASE and (depth or n < 64):
        return _sort_base(t, cap)
    small, ends = _types(t, s)
    found = lambda a, b: np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a
    seeds = s.new(sum(len(found(a, b)) for a, b in s.chunks(n, 1)), np.int32)
    at = 0
    for a, b in s.chunks(n, 1):
        part = found(a, b)
        seeds[at : at + len(part)] = part
        at += len(part)

    k = max(int(t[a:b].max()) for a, b in s.chunks(n)) + 1
    count, n_small = s.new(k, np.int64), s.new(k, np.int64)
    large_run, small_run = s.new(k, np.int32), s.new(k, np.int32)  # the longest in a bucket
    for a, b in s.chunks(n):
        x, is_small, run = t[a:b], small[a:b], ends[a:b] - np.arange(a, b, dtype=np.int32) + 1
        _add(count, x)
        _add(n_small, x[is_small])
        np.maximum.at(large_run, x[~is_small], run[~is_small])
        np.maximum.at(small_run, x[is_small], run[is_small])
    start, end = s.new(k, np.int64), s.new(k, np.int64)
    np.cumsum(count, out=end)
    np.subtract(end, count, out=start)

    sa, q = s.new(n, np.int32, -1), s.new(n + 1, np.int16, cap)
    for a, b in s.chunks(k):
        q[start[a:b][count[a:b] > 0]] = 0
    q[n] = 0
    if len(seeds):
        order, shared = _sort_seeds(t, seeds, cap, s, depth)
        per, before = s.new(k, np.int64), s.new(k, np.int64)
        for a, b in s.chunks(len(seeds)):
            _add(per, t[seeds[a:b]])
        np.cumsum(per, out=before)
        np.subtract(before, per, out=before)
        for a, b in s.chunks(len(seeds)):
            p = seeds[order[a:b]]
            c = t[p]
            nth = np.arange(a, b) - before[c]
            slot = end[c] - per[c] + nth
            value, first = np.array(shared[a:b]), nth == 0
            run = ends[p[first]] - p[first] + 1
            value[first] = np.minimum(np.minimum(large_run[c[first]], run), cap)
            sa[slot], q[slot] = p, value
        del order, shared, per, before
    del ends, seeds
    _induce(sa, q[:n], t, small, False, start, cap, n - 1, s)
    # the seeds have done their work; the small suffixes come from the right
    for a, b in s.chunks(k):
        at = np.flatnonzero(n_small[a:b]) + a
        first, last = end[at] - n_small[at], end[at]
        q[first] = np.minimum(np.minimum(large_run[at], small_run[at]), cap)
        long = last - first > s.chunk
        for x, y in zip(first[long].tolist(), last[long].tolist(), strict=True):
            sa[x:y] = -1
        first, last = first[~long], last[~long]
        while len(first):
            fit = max(1, int(np.searchsorted(np.cumsum(last - first), s.chunk, "right")))
            sa[_ranges(first[:fit], last[:fit])] = -1
            first, last = first[fit:], last[fit:]
    np.subtract(n, end, out=end)
    _induce(sa[::-1], q[::-1][:n], t, small, True, end, cap, None, s)
    return sa, q[:n]


def _sort_base(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion: ranks of doubling prefixes; they also give the shared ones."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    levels, width = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        if rank.max() == n - 1:
            break
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        width *= 2
    sa = np.argsort(rank, kind="stable")
    a, b = sa[:-1].copy(), sa[1:].copy()
    live = np.arange(n - 1)
    for i in reversed(range(len(levels) - 1)):
        x, y = a[live], b[live]
        ok = live[(x < n) & (y < n)]
        same = ok[levels[i][a[ok]] == levels[i][b[ok]]]
        a[same] += 1 << i
        b[same] += 1 << i
    lcp = np.zeros(n, np.int16)
    lcp[1:] = np.minimum(a - sa[:-1], cap)
    return sa.astype(np.int32), lcp


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = b - a
    return np.repeat(b - np.cumsum(n), n) + np.arange(n.sum())


def _sort_seeds(t: np.ndarray, seeds: np.ndarray, cap: int, s: Store, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the seeds' suffixes, and their shared prefixes: name the substrings between
    seeds, recurse on the names, translate common names back into common symbols."""
    m, n = len(seeds), len(t)
    names, distinct = _name(t, seeds, s)
    if distinct == m:
        order, same = s.new(m, np.int32), s.new(m, np.int16)
        for a, b in s.chunks(m):
            order[names[a:b]] = np.arange(a, b)
    else:
        order, same = _sort(names, cap, s, depth + 1)
    shared = s.new(m, np.int16)
    place = lambda i: np.where(i < m, seeds[np.minimum(i, m - 1)], n).astype(np.int64)
    for a, b in s.chunks(m):
        o = order[a:b].astype(np.int64)
        before = np.r_[order[a - 1 : a] if a else o[:1], o[:-1]].astype(np.int64)
        common = same[a:b].astype(np.int64)
        x, y = place(before + common), place(o + common)
        got = np.minimum(x - place(before), cap)
        live = np.flatnonzero((got < cap) & (np.arange(a, b) > 0))
        step = 0
        while len(live):
            i, j = x[live] + step, y[live] + step
            ok = (i < n) & (j < n)
            ok[ok] = t[i[ok]] == t[j[ok]]
            live = live[ok]
            got[live] += 1
            live = live[got[live] < cap]
            step += 1
        shared[a:b] = got
    shared[:1] = 0
    return order, shared


def _name(t: np.ndarray, seeds: np.ndarray, s: Store) -> tuple[np.ndarray, int]:
    """Dense ranks of the substrings from each seed to the next, equal ones alike, and how many
    there are. Substrings are compared by packed blocks of symbols; the place behind the text
    is below every symbol. Where one substring begins another, the longer one falls where the
    shorter one's last symbol begins a rise, so the shorter is the larger: it is filled up with
    a highest symbol. Parts that outgrow a chunk are split in three around a key, on disk.
    """
    m, n = len(seeds), len(t)
    bits = (max(int(t[a:b].max()) for a, b in s.chunks(n)) + 2).bit_length()
    per, fill = max(1, 63 // bits), (1 << bits) - 1

    def lengths(ids: np.ndarray) -> np.ndarray:
        return np.where(ids + 1 < m, seeds[np.minimum(ids + 1, m - 1)], n) - seeds[ids] + 1

    def keys(ids: np.ndarray, offset: int) -> np.ndarray:
        at, length, key = seeds[ids].astype(np.int64) + offset, lengths(ids) - offset, np.zeros(len(ids), np.int64)
        for j in range(per):
            x = at + j
            symbol = np.where(x < n, t[np.minimum(x, n - 1)].astype(np.int64) + 1, 0)
            key = (key << bits) | np.where(j < length, symbol, fill)
        return key

    def ranks(ids: np.ndarray, offset: int) -> np.ndarray:
        """In memory: block after block for those still tied."""
        rank, live = np.zeros(len(ids), np.int64), np.arange(len(ids))
        first = True
        while len(live):
            key = keys(ids[live], offset)
            order = np.argsort(key, kind="stable") if first else np.lexsort((key, rank[live]))
            r, v = rank[live][order], key[order]
            new = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])]
            group = np.flatnonzero(new)
            size = np.diff(np.r_[group, len(r)])
            # a rank is the number of substrings below: the old one plus those before it in its old group
            old = np.r_[True, r[1:] != r[:-1]]
            old_at = np.maximum.accumulate(np.where(old, np.arange(len(r)), 0))
            rank[live[order]] = r + np.repeat(group, size) - old_at
            tied = live[order][np.repeat(size > 1, size)]
            offset += per
            live = tied[lengths(ids[tied]) >= offset]
            first = False
        return np.unique(rank, return_inverse=True)[1]

    names, done = s.new(m, np.int32), 0
    every = s.new(m, np.int32)
    for a, b in s.chunks(m):
        every[a:b] = np.arange(a, b)
    todo = [(every, 0)]
    while todo:
        ids, offset = todo.pop()
        if offset is None:
            for a, b in s.chunks(len(ids)):
                names[ids[a:b]] = done
            done += len(ids) > 0
            continue
        if len(ids) <= s.chunk:
            if len(ids):
                local = ranks(np.asarray(ids, np.int64), offset)
                names[ids] = local + done
                done += int(local.max()) + 1
            continue
        sample = keys(np.asarray(ids[:: max(1, len(ids) // 255)], np.int64), offset)
        pivot = np.sort(sample)[len(sample) // 2]
        side = s.new(len(ids), np.int8)
        for a, b in s.chunks(len(ids)):
            key = keys(np.asarray(ids[a:b], np.int64), offset)
            side[a:b] = (key > pivot).astype(np.int8) - (key < pivot)
        parts = []
        for x in (1, 0, -1):
            part, put = s.new(int(np.count_nonzero(side == x)), np.int32), 0
            for a, b in s.chunks(len(ids)):
                chosen = ids[a:b][side[a:b] == x]
                part[put : put + len(chosen)] = chosen
                put += len(chosen)
            parts.append(part)
        more, equal, less = parts
        # whatever ended inside the block is all the same
        todo += [(more, offset), (equal, None if int(pivot) & fill == fill else offset + per), (less, offset)]
    return names, done


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each group of equal keys begins, and the end."""
    change = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1])
    out = np.empty(len(change) + 2, np.int64)
    out[0], out[1:-1], out[-1] = 0, change, len(sorted_keys)
    out[1:-1] += 1
    return out


def _induce(sa: np.ndarray, q: np.ndarray, t: np.ndarray, small: np.ndarray, want: bool, heads: np.ndarray, cap: int, end: int | None, s: Store) -> None:
    """One pass. ``sa`` and ``q`` are the queue's slots in popping order; a popped suffix
    pushes the one before it, if that is wanted (small or not), to the head of its bucket."""
    n, k = len(sa), len(heads)
    key_type = np.uint16 if k <= 1 << 16 else np.int32  # short keys are sorted by radix
    last_batch, last_min = s.new(k, np.int64, -2), s.new(k, np.int16, cap)
    if end is not None:  # the empty suffix comes first and pushes the last one
        sa[heads[t[end]]] = end
        heads[t[end]] += 1
        last_batch[t[end]] = -1
    ids: list[int] = []
    mins: list[int] = []
    i, size, batch = 0, 1024, 0
    while i < n:
        e = min(n, i + size)
        pre = sa[i:e]
        src = np.flatnonzero(pre > 0)
        pre = pre[src] - 1
        ok = small[pre] == want
        src, pre = src[ok], pre[ok]
        a = np.asarray(q[i:e])
        if len(src):
            p = t[pre].astype(key_type)
            order = p.argsort(kind="stable")
            po = p[order]
            first = _firsts(po)
            many = np.diff(first)
            place = heads[po]
            place += np.arange(len(po))
            place -= np.repeat(first[:-1], many)
            slot = np.empty(len(src), np.int64)
            slot[order] = place
            low = np.minimum.accumulate(slot)
            follow = np.empty(len(src), np.int64)
            follow[:-1], follow[-1] = src[1:], e - i
            follow += i
            cut = np.flatnonzero(low <= follow)
            if len(cut):
                e = min(e, int(low[cut[0]]))
                keep = int(cut[0]) + 1
                src, pre, slot = src[:keep], pre[:keep], slot[:keep]
                order = order[order < keep]
                po = p[order]
                first = _firsts(po)
                many = np.diff(first)
                a = a[: e - i]
            so = src[order]
            new = first[:-1]
            value = np.empty(len(order), np.int16)
            if len(new) < len(order):
                old = np.ones(len(order), bool)
                old[new] = False
                later = np.flatnonzero(old)
                value[later] = _range_min(a, so[later - 1] + 1, so[later] + 1)
            of = po[new]
            seen = last_batch[of]
            stack = np.searchsorted(ids, seen, "right")
            value[new] = np.minimum(np.minimum(last_min[of], np.array([*mins, cap], np.int16)[stack]), np.minimum.accumulate(a)[so[new]])
            sa[slot] = pre
            value += 1
            np.minimum(value, cap, out=value)
            fresh = new[seen == -2]  # the first of a bucket keeps what its boundary says
            where = slot[order]
            value[fresh] = q[where[fresh]]
            q[where] = value
            heads[of] += many
            tail = first[1:] - 1
            after = np.full(e - i + 1, cap, np.int16)
            after[:-1] = np.minimum.accumulate(a[::-1])[::-1]
            last_batch[of], last_min[of] = batch, after[so[tail] + 1]
        v = int(a.min())
        while mins and mins[-1] >= v:
            mins.pop()
            ids.pop()
        ids.append(batch)
        mins.append(v)
        size = min(1 << 15, max(64, 2 * size if e - i == size else 2 * (e - i)))
        i, batch = e, batch + 1


def _range_min(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of a[low:high] for many ranges, none empty, by a doubling table."""
    if not len(low):
        return np.zeros(0, np.int64)
    level = (np.frexp((high - low).astype(np.float32))[1] - 1).astype(np.uint8)
    out = np.empty(len(low), a.dtype)
    row, width = a, 1
    for lv in range(int(level.max()) + 1):
        pick = np.flatnonzero(level == lv)
        out[pick] = np.minimum(row[low[pick]], row[high[pick] - width])
        if len(row) > width:
            row = np.minimum(row[:-width], row[width:])
        width *= 2
    return out
