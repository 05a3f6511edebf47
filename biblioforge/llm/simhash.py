"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most three bits agree in at least five
byte positions. The index posts every distinct fingerprint under combinations of
(position, byte) so chosen that any five agreeing positions contain one; within a posting
list the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum
are dropped, the rest are verified on all 64 bits. A list returns only the edges of a
spanning forest of its links, never its pairs.

Equal fingerprints are one class from the start, so groups of copies cost one row. Lists
longer than ``BLOCK`` are cut into blocks that meet two at a time, each meeting a task of
its own of bounded size; nothing is dropped.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text
with fewer words than a shingle hashes its whole word sequence; equal and repeated rows get
the same component; rows with a null id count as rows but never name a component unless the
whole component has no id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, table
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Longest piece of a posting list that one task compares with one other.
BLOCK = 4096
#: Lists up to this length are compared many at a time.
SHORT = 64
BYTES = 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # splits on \x20 \x09-\x0D, lowers A-Z only
    if not words:
        return 0
    join, h = b" ".join, xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(join(words), seed)
    return majority([h(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))])


def majority(values: list[int]) -> int:
    """The bits that are set in over half of the 64-bit values; zero for none."""
    hashes = np.array(values, ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def index_keys(n: int, max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Position combinations of the index, chosen so that any ``BYTES - max_bits`` agreeing
    positions contain one: pairs inside one fewer groups than positions must agree, so two of
    them share a group. Where five must agree and lists of two bytes would grow long, all
    triples of either half serve instead (three of five lie in one half)."""
    agree = BYTES - max_bits
    if agree >= 5 and n > 65536 * 64:
        return [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
    if agree < 2:
        raise ValueError("at least two byte positions must agree")
    groups = np.array_split(np.arange(BYTES), agree - 1)
    return [c for g in groups for c in combinations(g.tolist(), 2)]


def agreeing(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) that agree in at least so many byte positions."""
    ab, bb = a.view(np.uint8).reshape(-1, BYTES), b.view(np.uint8).reshape(-1, BYTES)
    tally = np.zeros((len(a), len(b)), np.uint8)
    for p in range(BYTES):
        tally += ab[:, p, None] == bb[None, :, p]
    return np.nonzero(tally >= least)


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) that link, in strips of bounded size."""
    step = max(1, (1 << 20) // max(1, len(b)))
    ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), step):
        i, j = agreeing(a[at : at + step], b, BYTES - max_bits)
        near = np.bitwise_count(a[at + i] ^ b[j]) <= max_bits
        ii.append(i[near] + at)
        jj.append(j[near])
    return np.concatenate(ii), np.concatenate(jj)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member) stars of the components that the links make."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in range(n) if find(x) != x]


def postings(nodes: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Nodes (fps, any columns) under each key of each fingerprint: (k, v, fp, columns)."""
    keys = index_keys(n, max_bits)
    # the key holds which positions it is made of, so lists of different positions never mix
    masks = [sum(0xFF << 8 * p for p in c) for c in keys]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rest = [c for c in nodes.columns if c != "fps"]
    each = nodes.select(*rest, F.posexplode("fps").alias("s", "fp"))
    under = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)]))
    return each.select(*rest, "s", "fp", under.alias("x")).select((F.col("s") * len(keys) + F.col("x.k")).cast("int").alias("k"), "x.v", "fp", *rest)


def meetings(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lists (k, v, n) of ``sizes`` dealt out: block b of a list meets every block of it, itself
    too, as the task (lo, hi); each meeting's rows arrive together and in order."""
    lists = posted.join(sizes, ["k", "v"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    lists = lists.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")
    return met.repartition("k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi")


def whole_lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole lists, batch by batch, and where each list begins; names hold k, v, lo and hi."""
    held, marks = None, [names.index(c) for c in ("k", "v", "lo", "hi")]
    for batch in batches:
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        new = np.zeros(max(0, len(rows[0]) - 1), bool)
        for m in marks:
            new |= rows[m][1:] != rows[m][:-1]
        change = np.flatnonzero(new) + 1
        cut = int(change[-1]) if len(change) else 0
        held = [x[cut:] for x in rows]
        if cut:
            yield [x[:cut] for x in rows], np.r_[0, change[:-1]]
    if held is not None and len(held[0]) > 1:
        yield held, np.zeros(1, np.int64)


def link_edges(nodes: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) enough to connect all nodes that link, by one of their fingerprints at least.
    Nodes are (node, fps), or distinct fingerprints (fp), which then name themselves."""
    named = "node" in nodes.columns
    posted = postings(nodes if named else nodes.select(F.array("fp").alias("fps")), n, max_bits)
    sizes = posted.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")

    def long_list(fp: np.ndarray, ids: np.ndarray, first: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
        """Edges of one meeting of two blocks, or of a block with itself."""
        side = first == lo
        one = fp[side]
        i, j = _linked(one, one if lo == hi else fp[~side], max_bits)
        if lo == hi:
            i, j = i[i < j], j[i < j]
        else:
            j, ids = j + len(one), np.concatenate([ids[side], ids[~side]])
        return [(int(ids[x]), int(ids[y])) for x, y in forest(len(ids), i, j)]

    def short_lists(fp: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
        """Edges of many lists at once: pairs at distance 1, 2, ... inside their lists."""
        left = np.repeat(start + size, size) - np.arange(len(fp)) - 1  # rows of the list after each
        ii, jj = [], []
        for d in range(1, int(size.max())):
            i = np.flatnonzero(left >= d)
            diff = fp[i] ^ fp[i + d]
            tally = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            i = i[(tally >= BYTES - max_bits) & (np.bitwise_count(diff) <= max_bits)]
            ii.append(i)
            jj.append(i + d)
        i, j = np.concatenate(ii), np.concatenate(jj)
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        return [(int(ids[used[x]]), int(ids[used[y]])) for x, y in forest(len(used), back[: len(i)], back[len(i) :])]

    def edges_of(fp: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
        """Rows of whole lists that begin at ``at``."""
        size = np.diff(np.r_[at, len(fp)])
        many = size > SHORT
        out = [e for a, n in zip(at[many], size[many], strict=True) for e in long_list(fp[a : a + n], ids[a : a + n], own[a : a + n], int(lo[a]), int(hi[a]))]
        few = ~many & (size > 1)
        if few.any():
            rows = np.repeat(few, size)
            n = size[few]
            out += short_lists(fp[rows], ids[rows], np.cumsum(n) - n, n)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists arrive sorted; each is at most two blocks long, most are a few rows."""
        for (fp, _, _, own, lo, hi, ids), at in whole_lists(batches, ("fp", "k", "v", "own", "lo", "hi", "node" if named else "fp")):
            yield edge_batch(edges_of(fp.view(np.uint64), ids, at, own, lo, hi))

    def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return meetings(posted, sizes).mapInArrow(run, "a long, b long")


def components_of(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): every distinct fingerprint of a materialized table with that of its component."""
    classes = materialize(fps.select("fp").distinct())
    labels = connected_components(link_edges(classes, classes.count(), max_bits))
    return classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component)."""
    fps = materialize(fingerprints(docs, shingle))
    roots = materialize(components_of(fps, max_bits))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    heads = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(roots.join(heads, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
