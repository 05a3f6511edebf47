"""Best-fit packing with swap-based local search.

Tokenizing is one pass over the texts; only piece lengths and checksums travel on. Pieces
are dealt evenly into groups of bounded size, each group is packed best fit decreasing and
then improved by local search (moves, one-for-one and two-for-one exchanges that raise the
sum of squared fills) until bins empty. The pieces of bins that stay loose are dealt anew into
as many groups of that size as they fill and packed again, as long as that saves more than
one bin in two hundred; so the waste does not grow with the number of groups, and no task
gets more than a group.

Defined cases: a null or empty text is one piece, the end id alone; texts of any length are
cut into full pieces, the first taking the remainder; ties and repeated rows are packed each
on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY = 2048
GROUP_PIECES = 4096
#: A bin below this share is packed again with other groups' loose bins.
LOOSE = 0.985
#: Packing loose bins again ends where it saves a smaller share of them.
LEAST_SAVED = 0.005
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PLACED = PIECES + ", bin long, offset long, fill long"


def _encoder(ranks_path: str):
    """The byte-level vocabulary through its rank file: same ids as the JSON file's
    tokenizer gives, at several times the speed (tests compare the two)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """A row per piece of each document (doc_id, text). ``deal`` numbers rows by task, for even dealing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks_path or default_ranks())
        deal = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                ids = np.concatenate([enc.encode_to_numpy(t, allowed_special="all").astype("<u4"), end])
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + capacity] if k else ids[:first]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), deal))
                    deal += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes. A bitmask over remaining room finds the tightest bin at once."""
    bins: list[list[int]] = []
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := mask >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room_of[r].pop()
            if not room_of[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > n:
            room_of[r - n].append(b)
            mask |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Drains the emptiest bins into fuller underfull ones.

    A step moves a piece, or exchanges one or two pieces of the emptiest bin for one of
    another, where the other has room for the difference; each step moves length from an
    emptier bin to a fuller one, so the sum of squared fills rises and the search ends. A bin
    that no other can take from is left as it is; the search goes on with the next.
    """
    size = lengths.tolist()
    fill = np.array([sum(size[i] for i in b) for b in bins], np.int64)
    least = np.array([min(size[i] for i in b) for b in bins], np.int64)
    order = np.flatnonzero(fill < capacity)
    order = order[np.argsort(fill[order], kind="stable")]
    while len(order) > 1:
        src, order = int(order[0]), order[1:]
        left = order  # bins still to visit, the fullest last
        while bins[src] and len(left) and (capacity - fill[order]).sum() >= fill[src]:
            # only these can take a piece, or give one back that is smaller than what they get
            ours = sorted(size[i] for i in bins[src])
            able = np.flatnonzero((capacity - fill[left] >= ours[0]) | (least[left] < sum(ours[-2:])))
            step = None
            for at in able[::-1].tolist():
                dst = int(left[at])
                if step := _step(bins[src], bins[dst], size, int(capacity - fill[dst]), int(fill[dst] - fill[src])):
                    break
            if step is None:
                break
            left = left[: at + 1]
            give, take = step
            for i in give:
                bins[src].remove(i)
            for i in take:
                bins[dst].remove(i)
            bins[src] += take
            bins[dst] += give
            delta = sum(size[i] for i in give) - sum(size[i] for i in take)
            fill[src] -= delta
            fill[dst] += delta
            least[dst] = min(size[i] for i in bins[dst])
        order = order[fill[order] < capacity]
        order = order[np.argsort(fill[order], kind="stable")]
    return [b for b in bins if b]


def _step(src: list[int], dst: list[int], size: list[int], room: int, ahead: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills dst most: (pieces given, pieces taken back). Of pieces of one
    length one stands for all, so a bin has few choices whatever it holds."""
    if room <= 0:
        return None
    ours: dict[int, list[int]] = {}
    for i in src:
        ours.setdefault(size[i], []).append(i)
    theirs = {size[j]: j for j in dst}
    back = sorted(theirs)
    gives = [(n, 0) for n in ours] + [(m, n) for m, n in combinations(ours, 2)] + [(n, n) for n, x in ours.items() if len(x) > 1]
    best, found = max(0, -ahead), None
    for m, n in gives:
        g = m + n
        if best < g <= room:
            best, found = g, (m, n, 0)
        at = bisect_left(back, g - room)  # the smallest that makes room
        if g > room and at < len(back) and best < g - back[at]:
            best, found = g - back[at], (m, n, back[at])
    if found is None:
        return None
    m, n, taken = found
    give = [ours[m][0]] + ([ours[n][1 if n == m else 0]] if n else [])
    return give, [theirs[taken]] if taken else []


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in it and its fill, for each length."""
    bins = local_search(best_fit_decreasing(lengths, capacity), lengths, capacity)
    number, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            number[i], offset[i] = b, at
            at += int(lengths[i])
        fill[members] = at
    return number, offset, fill


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to materialized pieces."""

    def packer(level: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "deal"], ascending=[False, True], kind="stable").reset_index(drop=True)
            number, offset, fill = pack_lengths(pdf["length"].to_numpy(), capacity)
            base = (level << 56) + int(pdf["grp"].iloc[0]) * (4 * group_pieces + 1024)
            return pdf.drop(columns="grp").assign(bin=base + number, offset=offset, fill=fill)

        return one

    deal = lambda rows, level, n: rows.withColumn("grp", F.pmod(F.xxhash64("deal", F.lit(level)), F.lit(max(1, -(-n // group_pieces)))))
    n, level, settled, before = pieces.count(), 0, [], None
    todo = deal(pieces, 0, n)
    while True:
        packed = materialize(todo.groupBy("grp").applyInPandas(packer(level), PLACED))
        loose = F.col("fill") < int(LOOSE * capacity)
        seen = packed.agg(F.count_if(loose).alias("n"), F.count_distinct("bin").alias("bins")).first()
        saved = 1.0 if before is None else (before - seen.bins) / max(1, before)
        if seen.n == 0 or n <= group_pieces or saved < LEAST_SAVED:
            parts = [*settled, packed]
            done = parts[0]
            for p in parts[1:]:
                done = done.unionByName(p)
            return done.drop("fill", "deal").withColumnRenamed("bin", "sequence_id")
        settled.append(packed.where(~loose))
        again = packed.where(loose)
        before = again.agg(F.count_distinct("bin").alias("bins")).first().bins
        n, level = seen.n, level + 1
        todo = deal(again.drop("bin", "offset", "fill"), level, n)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(token_pieces(table(spark, sf_dir, "documents"))))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
