"""Removal of long repeated byte strings by external induced suffix sorting.

1. One scan cuts every text's windows of ``length`` bytes into runs that share a
   content-chosen anchor (``anchors``). Equal windows always meet under one anchor, so an
   anchor seen once cannot hide a repeat; only the others go on.
2. Equal segments under an anchor are one segment with a count. Where an anchor has one
   segment only, all of it is repeated as often as it was counted.
3. The segments of the other anchors are dealt out by anchor, and each shard is suffix
   sorted with common-prefix values (``induced``): its text and queues lie in unnamed files
   of the task, far larger than what is held in memory. Neighbours that share ``length``
   bytes mark repeated windows.
4. An anchor with more than ``HOT_SEGMENTS`` different segments (a passage shorter than
   ``length`` in a large share of all texts) would be one long shard. Its windows meet by
   128-bit hash instead, counted before they are shuffled, so it spreads like any other rows.
5. The covered ranges go back to every text that holds the segment.

Only hashes, places and segments under repeated anchors are shuffled by anchor; texts are
shuffled by their own key. Hashes select candidates, they never decide: a repeat is decided
by sorted bytes, or by equality of 128-bit hashes for whole segments and hot windows.

Defined cases: a null or empty text has no bytes and loses none; texts shorter than
``length`` lose none; every copy of a repeated text loses all that is repeated, so all of it
from ``length`` bytes on; rows with null or repeated ids are handled each on their own;
columns of any other names are kept by ``remove_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .anchors import anchored_runs, gram_hashes
from .common import discard, map_batches, materialize, table, tasks_for

LENGTH, GRAM = 400, 176
#: Bytes of distinct segments that one call of the sorter takes, if anchors end there.
SHARD_BYTES = 2 << 20
#: Different segments of an anchor beyond which its windows meet by hash.
HOT_SEGMENTS = 2000
KEY, RANGES = "__text_key", "__ranges"
#: Byte between the blocks of a scoped text.
BARRIER = 0x1F


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a 128-bit key of their text."""
    return docs.withColumn(KEY, F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))


def runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, anchor, seg, first, last, back): a row per run of windows with one anchor.
    With a third column, its text keeps anchors of different scopes apart, and no window
    holds a ``BARRIER``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            scopes = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for key, text, scope in zip(batch.column(0), batch.column(1), scopes, strict=True):
                raw = (text.as_py() or "").encode()
                anchor, first, last, back = anchored_runs(np.frombuffer(raw, np.uint8), length, gram, None if scope is None else BARRIER)
                if scope is not None:
                    anchor = anchor ^ np.uint64(xxhash.xxh3_64_intdigest(scope))
                if len(anchor):
                    view = memoryview(raw)
                    seg = np.array([xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                    rows.append((key.as_py(), anchor, seg, first, last, back))
                    size += len(anchor)
                if size > 50_000:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        n = [len(r[1]) for r in rows]
        cols = [np.concatenate([r[i] for r in rows]) for i in range(1, 6)]
        keys = pa.array([r[0] for r, k in zip(rows, n, strict=True) for _ in range(k)], pa.binary())
        nums = [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4])]
        return pa.RecordBatch.from_arrays([keys, *nums], names=["key", "anchor", "seg", "first", "last", "back"])

    return texts.mapInArrow(run, "key binary, anchor long, seg long, first int, last int, back boolean")


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the windows at sorted starts, touching ones merged."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


class Shard:
    """Segments on disk: their bytes in an unnamed file, a few numbers for each in arrays."""

    def __init__(self):
        self.data, self.size = tempfile.TemporaryFile(prefix="suffix-spill-"), 0
        self.anchors, self.segs, self.counts, self.sizes, self.owners = (array("q") for _ in range(5))

    def add(self, anchor: int, seg: int, count: int, data: bytes, owner: bytes = b"") -> None:
        self.data.write(data)
        self.size += len(data)
        for a, x in ((self.anchors, anchor), (self.segs, seg), (self.counts, count), (self.sizes, len(data)), (self.owners, xxhash.xxh3_64_intdigest(owner) >> 1)):
            a.append(x)

    def repeats(self, length: int, across: bool = False, memory_bytes: int | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(number of the segment, ranges covered by windows that occur twice), by suffix
        sorting all of them. ``across``: twice means in segments of two owners."""
        s = induced.Store(induced.MEMORY_BYTES if memory_bytes is None else memory_bytes)
        sizes, counts = np.frombuffer(self.sizes, np.int64), np.frombuffer(self.counts, np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(sizes)
        text, whole, hit = s.new(n, np.int32), s.new(n, bool), s.new(n, bool)  # whole: windows that end inside their segment
        self.data.seek(0)
        cuts = np.r_[np.searchsorted(begin, np.arange(0, n, max(1, s.chunk))), len(sizes)]
        groups = [(int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if x < y]
        for x, y in groups:
            for at, size, count in zip(begin[x:y].tolist(), sizes[x:y].tolist(), counts[x:y].tolist(), strict=True):
                text[at : at + size] = np.frombuffer(self.data.read(size), np.uint8)
                text[at : at + size] += 1
                if size >= length:
                    whole[at : at + size - length + 1] = True
                    hit[at : at + size - length + 1] = count > 1
        with induced.sorted_suffixes(text, length, s) as (sa, lcp):
            del text
            if across:
                self._mixed(sa, lcp, whole, hit, begin, length, s)
            else:
                for a, b in s.chunks(n, 1):
                    here, before = sa[a:b], sa[a - 1 : b - 1]
                    same = (lcp[a:b] >= length) & whole[here]
                    hit[here[same]] = hit[before[same]] = True
            del sa, lcp
        self.spilled = s.spilled
        for x, y in groups:
            low, high = int(begin[x]), int(begin[y - 1] + sizes[y - 1])
            found = np.flatnonzero(hit[low:high]) + low
            parts = np.searchsorted(found, np.append(begin[x:y], high))
            for i, (a, b) in enumerate(zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True), x):
                if a < b:
                    yield i, covered(found[a:b] - begin[i], length)

    def _mixed(self, sa, lcp, whole, hit, begin, length: int, s: induced.Store) -> None:
        """Marks windows that segments of two owners hold. Equal ones lie side by side."""
        owners = np.frombuffer(self.owners, np.int64)
        of = lambda at: owners[np.searchsorted(begin, at, "right") - 1]
        a = 0
        while a < len(sa):
            b = min(len(sa), a + s.chunk)
            while b < len(sa):  # a group of equal windows is not cut
                new = np.flatnonzero(lcp[b : b + s.chunk] < length)
                if len(new):
                    b += int(new[0])
                    break
                b = min(len(sa), b + s.chunk)
            rows = np.flatnonzero(whole[sa[a:b]])
            if len(rows):
                here = sa[a:b][rows]
                new = lcp[a:b][rows] < length
                new[0] = True
                at, owner = np.flatnonzero(new), of(here)
                mixed = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
                hit[here[mixed[np.cumsum(new) - 1]]] = True
            a = b


def repeats_in(segments: Iterable[tuple[int, bytes]], length: int, owners: Iterable[bytes] | None = None, memory_bytes: int | None = None) -> list[list[tuple[int, int]]]:
    """The repeated ranges of each (count, bytes)."""
    shard = Shard()
    for (count, data), owner in zip(segments, owners if owners is not None else iter(lambda: b"", None), strict=False):
        shard.add(0, 0, count, data, owner)
    out: list[list[tuple[int, int]]] = [[] for _ in shard.sizes]
    for i, ranges in shard.repeats(length, owners is not None, memory_bytes):
        out[i] = ranges
    return out


RANGES_KIND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = "anchor long, seg long, ranges array<struct<a: int, b: int>>"


def _found(rows: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    ranges = pa.array([[{"a": a, "b": b} for a, b in r] for r in cols[2]], RANGES_KIND)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), ranges], names=["anchor", "seg", "ranges"])


def sort_segments(segments: DataFrame, length: int, total: int, across: bool = False, shard_bytes: int | None = None) -> DataFrame:
    """(anchor, seg, n, data, owner) of so many bytes in all -> (anchor, seg, ranges), shard by shard."""
    most = shard_bytes or SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(), None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[:2] == last:
                    continue  # a repeated row of the same text
                if last is not None and row[0] != last[0] and shard.size >= most:
                    yield from sort(shard)
                    shard = Shard()
                shard.add(*row)
                last = row[:2]
        if len(shard.sizes):
            yield from sort(shard)

    def sort(shard: Shard) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, ranges in shard.repeats(length, across):
            rows.append((shard.anchors[i], shard.segs[i], ranges))
            if len(rows) >= 10_000:
                yield _found(rows)
                rows = []
        yield _found(rows)

    return segments.repartition(tasks_for(total, most), "anchor").sortWithinPartitions("anchor", "seg").mapInArrow(run, FOUND)


def hot_windows(segments: DataFrame, length: int, across: bool = False) -> DataFrame:
    """The same for segments under hot anchors: equal windows meet by 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, n, data, owner in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                raw = np.frombuffer(data, np.uint8)
                one, two = gram_hashes(raw, length), gram_hashes(raw, length, 1)
                k = len(one)
                same = lambda x, kind, k=k: pa.array([x] * k, kind)
                yield pa.RecordBatch.from_arrays(
                    [same(anchor, pa.int64()), same(seg, pa.int64()), same(n, pa.int64()), same(xxhash.xxh3_64_intdigest(owner) >> 1, pa.int64()), pa.array(np.arange(k, dtype=np.int32)),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["anchor", "seg", "n", "owner", "at", "one", "two"],
                )

    windows = materialize(segments.mapInArrow(run, "anchor long, seg long, n long, owner long, at int, one long, two long"))
    twice = (F.max("n") > 1) | ((F.min("owner") != F.max("owner")) if across else (F.sum("n") > 1))
    again = windows.groupBy("one", "two").agg(twice.alias("twice")).where("twice").select("one", "two")
    starts = windows.join(again, ["one", "two"]).groupBy("anchor", "seg").agg(F.sort_array(F.collect_list("at")).alias("starts"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield _found([(a, g, covered(np.array(x), length)) for a, g, x in rows])

    return starts.mapInArrow(cover, FOUND)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, across: bool = False, shard_bytes: int | None = None) -> DataFrame:
    """(__text_key, __ranges): the repeated byte ranges of each text that has any, for rows
    (__text_key, text) and perhaps a scope inside which repeats count; no repeat of a scoped
    text reaches over a ``BARRIER``. With ``across`` a
    string must be in texts of two keys; otherwise one text may repeat it by itself."""
    every = materialize(runs(texts, length, gram))
    told = every.withColumn("back", F.lit(False)) if across else every
    # a class counts its occurrences, or the keys it is in
    times = F.count("*") if not across else F.when(F.min("key") != F.max("key"), 2).otherwise(1).cast("long")
    twice = told.groupBy("anchor").agg(times.alias("n"), F.max("back").alias("b")).where("n > 1 OR b").select("anchor")
    live = materialize(told.join(twice, "anchor"))
    discard(every)
    classes = live.groupBy("anchor", "seg").agg(times.alias("n"), F.max("back").alias("back"), F.min(F.struct("key", "first", "last")).alias("rep"))
    classes = materialize(classes)
    many = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.max("back").alias("b")).where("k > 1 OR b").select("anchor", "k")
    unsorted = materialize(classes.join(many, "anchor"))
    alone = materialize(classes.join(many, "anchor", "left_anti").where("n > 1").select(
        "anchor", "seg", F.array(F.struct(F.lit(0).alias("a"), (F.col("rep.last") - F.col("rep.first") + length).cast("int").alias("b"))).alias("ranges")
    ))
    discard(classes)
    hot = F.col("k") > HOT_SEGMENTS
    sums = unsorted.select(hot.alias("hot"), (F.col("rep.last") - F.col("rep.first") + length).cast("long").alias("size")).groupBy("hot").agg(F.sum("size").alias("size"))
    sizes = {r.hot: r["size"] for r in sums.collect()}

    # the bytes of one holder of each segment
    def with_text(which: DataFrame) -> DataFrame:
        wanted = which.groupBy(F.col("rep.key").alias(KEY)).agg(F.collect_list(F.struct("anchor", "seg", "n", "rep.first", "rep.last")).alias("want"))
        one_each = texts.groupBy(KEY).agg(F.first("text").alias("text"))
        return one_each.join(wanted, KEY).select("text", "want", KEY).mapInArrow(cut, "anchor long, seg long, n long, data binary, owner binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text, want, key in zip(*batch.columns, strict=True):
                raw, owner = (text.as_py() or "").encode(), key.as_py()
                for w in want.as_py():
                    rows.append((w["anchor"], w["seg"], w["n"], raw[w["first"] : w["last"] + length], owner))
                    size += len(rows[-1][3])
                if size > 8 << 20:
                    yield segment_batch(rows)
                    rows, size = [], 0
            if rows:
                yield segment_batch(rows)

    def segment_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "seg", "n", "data", "owner"])

    found = alone
    if False in sizes:
        found = found.unionByName(sort_segments(with_text(unsorted.where(~hot)), length, sizes[False], across, shard_bytes))
    if True in sizes:
        found = found.unionByName(hot_windows(with_text(unsorted.where(hot)), length, across))
    held = live.select("key", "anchor", "seg", "first").distinct()
    placed = held.join(materialize(found), ["anchor", "seg"])
    return placed.groupBy(F.col("key").alias(KEY)).agg(
        F.flatten(F.collect_list(F.transform("ranges", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))))).alias(RANGES)
    )


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row with its text cut (whole characters only) and what the cut was, in a struct
    ``cut``: n_bytes, n_removed, n_spans, kept_sha256 (of the exact remaining bytes)."""
    given = keyed(docs).join(repeated_ranges(keyed(docs).select(KEY, "text"), length, gram), KEY, "left").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest"), "text", RANGES
    )
    rest = given.schema["__rest"].dataType.simpleString()
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cuts = [], []
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            spans = merge([(r["a"], r["b"]) for r in ranges.as_py() or []])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
            texts.append(kept.decode(errors="ignore") if text.is_valid else None)
            cuts.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(cuts, kind)], names=["__rest", "text", "cut"])

    done = map_batches(given, run, f"__rest {rest}, text string, cut struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string>")
    return done.select(*[F.col("text") if c == "text" else F.col("__rest")[c].alias(c) for c in docs.columns], F.col("cut").alias("__cut"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "__cut.*")


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
