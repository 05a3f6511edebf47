"""Near copies by SimHash candidates and exact five-word similarity.

Fingerprints of the distinct words of a text, one for each seed, choose candidates over the
byte-position index of ``simhash``: pairs whose shared positional bytes reach the guaranteed
minimum and that differ in at most ``MAX_BITS`` bits under one seed. A candidate links if its
sets of five-word shingles have a Jaccard similarity of 0.8 or more. Links join rows into
groups.

Equal texts are one class from the start. Candidates of all lists make components; inside one,
the members' shingle sets meet, in blocks of ``MEMBERS``, each meeting a task of its own. A
meeting compares the candidates of fewest differing bits first and leaves out those that its
links already join, so a group of thousands around one text costs little more than a
comparison a member, no link is lost, and what is returned grows with the members, not with
their pairs.

Defined cases: a null or empty text has the empty set of words and shingles and is alike to
its equals only; a text with fewer words than a shingle is one shingle; of each group the
smallest doc_id stays, of rows alike in that one; null ids stay only where a group has no
other; columns of any names are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize
from .components import connected_components

#: Seeds of the fingerprints, bits that may differ under one of them.
SEEDS, MAX_BITS = (42, 43), 5
SHINGLE, SIMILARITY = 5, 0.8
#: Members of a component that one task compares with as many others.
MEMBERS = 512


def fingerprints_of(text: str | None, seeds: tuple[int, ...] = SEEDS) -> list[int]:
    """A fingerprint of the distinct words for each seed, as signed 64-bit numbers."""
    words = list(dict.fromkeys((text or "").encode("utf-8", "surrogatepass").lower().split()))
    return [simhash.majority([xxhash.xxh64_intdigest(w, s) for w in words]) for s in seeds]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of lower-cased words, as signed numbers in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    join, h = b" ".join, xxhash.xxh3_64_intdigest
    hashes = [h(join(s)) for s in zip(*(words[i:] for i in range(shingle)))] if len(words) >= shingle else [h(join(words))]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def alike(x: np.ndarray, y: np.ndarray, per_mille: int) -> bool:
    low, high = sorted((len(x), len(y)))
    if not low or 1000 * low < per_mille * high:
        return False
    both = np.sort(np.concatenate([x, y]))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 1000 * same >= per_mille * (low + high - same)


def meeting_links(fps: np.ndarray, sets: list[np.ndarray], one: np.ndarray, max_bits: int, per_mille: int) -> list[tuple[int, int]]:
    """Links that join all alike candidates of a meeting: of the rows in ``one`` with all
    others, or, where all are in it, among themselves."""
    first = np.flatnonzero(one)
    if not len(first):  # a block without members
        return []
    second = first if one.all() else np.flatnonzero(~one)
    found = []
    for i in first.tolist():
        js = second[second > i] if one.all() else second
        bits = np.bitwise_count(fps[i] ^ fps[js]).min(axis=1)
        ok = bits <= max_bits
        found.append((bits[ok], np.full(int(ok.sum()), i), js[ok]))
    bits, ii, jj = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(bits, kind="stable")
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(ii[order].tolist(), jj[order].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b and alike(sets[i], sets[j], per_mille):
            parent[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def groups(nodes: DataFrame, texts: DataFrame, max_bits: int = MAX_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that link to another. Nodes are (node, fps), texts (node,
    text), both materialized."""
    candidates = connected_components(simhash.link_edges(nodes, nodes.count(), max_bits))
    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))

    @F.pandas_udf("array<long>")
    def set_of(ts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t) for t in ts])

    placed = candidates.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = materialize(texts.join(placed, "node").join(nodes, "node").select("component", "blocks", "own", "node", "fps", set_of("text").alias("s")))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "fps", "s")
    dealt = met.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    per_mille = round(1000 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for at, key in enumerate(keys):
                if key != last and held:
                    yield links(held, last)
                    held = []
                last = key
                fps, s = (np.array(batch.column(c)[at].values) for c in (5, 6))
                held.append((batch.column(3)[at].as_py(), batch.column(4)[at].as_py(), fps, s))
        if held:
            yield links(held, last)

    def links(held: list[tuple], key: tuple[int, int, int]) -> pa.RecordBatch:
        own, node = np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64)
        pairs = meeting_links(np.stack([h[2] for h in held]).view(np.uint64), [h[3] for h in held], own == key[1], max_bits, per_mille)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

    return connected_components(dealt.mapInArrow(run, "a long, b long"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (any columns, a doc_id and a text), one of each group of near copies."""

    @F.pandas_udf("array<long>")
    def fps_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprints_of(t), np.uint64).view(np.int64) for t in texts])

    key = F.md5(F.encode(F.coalesce("doc.text", F.lit("")), "UTF-8"))
    rows = materialize(docs.select(F.struct("*").alias("doc")).select("doc", key.alias("key"), fps_of("doc.text").alias("fps"), F.monotonically_increasing_id().alias("row")))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    classes = rows.select(F.col("doc.doc_id").alias("id"), "key", "fps", "row").groupBy("key").agg(F.min(order).alias("best"), F.min("fps").alias("fps"))
    heads = materialize(classes.select(F.col("best.row").alias("node"), "best", "fps"))
    labels = groups(heads.select("node", "fps"), rows.select(F.col("row").alias("node"), F.col("doc.text").alias("text")), max_bits, similarity)
    of = heads.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("group"))
    kept = of.agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
