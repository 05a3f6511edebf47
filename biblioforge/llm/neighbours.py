"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node with its smallest ids. Every node starts with neighbours from random
groups. A round joins each node's neighbours and a random sample of the nodes that name it
(its list, of bounded length) with their codes, meets all pairs of a list of which one is new, and
keeps each node's nearest; rounds go on until few entries change. Lists are ranked by windows
whose limit applies before the shuffle too, so nodes that many others name are no hot spots.

The graph is a table bucketed by node, each row with its neighbours' codes. A query holds a beam
of its nearest nodes so far; each hop joins the beam's unread nodes with the graph, which is not
shuffled, and merges their neighbours into the beam. It ends where all of a beam is read.
The beam's nearest are ranked by the original vectors in double precision.

Codes are vectors in signed bytes with one scale each; they only lead the way. ``REACH`` is what
recall depends on: measured on 51,282 rows of 64 nearly independent dimensions, see the README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id take no part; a repeated id counts once, with its smallest vector; shorter vectors
are filled up with zeros; ties go to the smaller id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table

K = 10
#: Neighbours of a node; sampled nodes that name it; most rounds, and the share of new entries that ends them.
DEGREE, BACK, ROUNDS, CHANGED = 20, 16, 8, 0.08
#: Nodes of a query's beam, and how many of them are ranked by the original vectors.
REACH, RANKED = 512, 64
GROUP, GROUPINGS = 16, 2
_EDGE = "a long, b long, d float"


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): doubles as bytes, without zeros at the end."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or v is None or any(c is None for c in v):
                continue
            x = np.trim_zeros(np.asarray(v, np.float64) + 0.0, "b")
            if len(x) and np.isfinite(x).all():
                ids.append(i)
                out.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "x"])

    return map_batches(vectors.select(id_col, vector_col), run, "vec_id long, x binary").groupBy("vec_id").agg(F.min("x").alias("x"))


def with_codes(rows: DataFrame, name: str, width: int) -> DataFrame:
    """(name, x) with ``code``: a scale and ``width`` signed bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = []
        for x in batch.column(1):
            v = np.zeros(width)
            raw = np.frombuffer(x.as_py())
            v[: len(raw)] = raw
            scale = np.float32(np.abs(v).max() / 127)
            codes.append(scale.tobytes() + (np.rint(v / scale) if scale > 0 else v).astype(np.int8).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=[name, "x", "code"])

    return map_batches(rows.select(name, "x"), run, f"{name} long, x binary, code binary")


def decode(codes: pa.Array) -> np.ndarray:
    n = len(codes)
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(n, -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _merged(rows: DataFrame, mark: str, most: int) -> DataFrame:
    """Rows (a, b, d, mark, code) to each a's ``most`` nearest b with ``far``, the worst of a full list
    (else infinity), and place ``n``. A pair counts once, and its mark is what an old row says:
    AND of fresh, OR of read. One row of each a at least brings its code; all rows of it get it.
    One shuffle by a serves the sum by pair and the windows."""
    once = F.min if mark == "fresh" else F.max
    pairs = rows.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), once(mark).alias(mark), F.max("code").alias("code"))
    mine = Window.partitionBy("a").orderBy("d", "b")
    whole = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = pairs.withColumns({"n": F.row_number().over(mine), "code": F.max("code").over(whole)}).where(F.col("n") <= most)
    return top.withColumn("far", F.when(F.count("d").over(whole) >= most, F.max("d").over(whole)).otherwise(F.lit(float("inf")).cast("float")))


def _nearest_of_batch(a: np.ndarray, b: np.ndarray, d: np.ndarray, most: int) -> pa.RecordBatch:
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, d = a[new], b[new], d[new]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < most
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(d[keep], pa.float32())], names=["a", "b", "d"])


def _meet(lists: DataFrame, degree: int) -> DataFrame:
    """Lists of (b, fresh, far, code) to pairs (a, b, d), of which one is new and which are nearer
    than a's farthest neighbour."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        at, flat = np.asarray(column.offsets), column.flatten()
        at = at - at[0]
        ids, fresh, far = (np.asarray(flat.field(n)) if n != "fresh" else flat.field(n).to_numpy(zero_copy_only=False) for n in ("b", "fresh", "far"))
        x = decode(flat.field("code"))
        sq = np.einsum("ij,ij->i", x, x)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for s in range(0, len(at) - 1, 256):
            first, last = at[s : s + 257][:-1], at[s : s + 257][1:]
            n = last - first
            place = first[:, None] + np.arange(n.max(initial=0))
            held = place < last[:, None]
            place = np.minimum(place, len(ids) - 1)
            y = x[place]
            d = sq[place][:, :, None] + sq[place][:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
            d = np.maximum(d, 0)
            ok = held[:, :, None] & held[:, None, :] & (fresh[place][:, :, None] | fresh[place][:, None, :]) & (d < far[place][:, :, None]) & (ids[place][:, :, None] != ids[place][:, None, :])
            g, i, j = np.nonzero(ok)
            out.append((ids[place[g, i]], ids[place[g, j]], d[g, i, j]))
        return _nearest_of_batch(*map(np.concatenate, zip(*out, strict=True)), degree)

    return map_batches(lists, run, _EDGE)


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, back: int = BACK, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, d): each node's nearest found, of a table (node, code); d is squared."""
    count = nodes.count()
    groups = max(1, count // GROUP)
    tries = nodes.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(GROUPINGS)))).withColumn("group", F.pmod(F.xxhash64("node", "try"), F.lit(groups)))
    item = F.struct(F.col("node").alias("b"), F.lit(True).alias("fresh"), F.lit(float("inf")).cast("float").alias("far"), "code")
    start = _meet(tries.groupBy("try", "group").agg(F.collect_list(item).alias("list")).select("list"), degree).withColumns({"fresh": F.lit(True), "code": F.lit(None).cast("binary")})
    own = nodes.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(float("inf")).cast("float").alias("d"), F.lit(True).alias("fresh"), "code")
    # a node's code comes with its own row, which has no b and is the last of a list that is not full
    edges = materialize(_merged(start.unionByName(own), "fresh", degree))
    for turn in range(rounds):
        live = edges.where("b IS NOT NULL")
        known = edges.where("n = 1").select(F.col("a").alias("b"), "code", "far")
        chance = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(turn)), "a"))
        named = live.select("a", "b", "fresh").withColumn("k", chance).where(F.col("k") <= back).select(F.col("b").alias("v"), F.col("a").alias("b"), "fresh")
        both = live.select(F.col("a").alias("v"), "b", "fresh").unionByName(named)
        lists = both.join(known, "b").groupBy("v").agg(F.collect_list(F.struct("b", "fresh", "far", "code")).alias("list")).select("list")
        found = _meet(lists, degree).withColumns({"fresh": F.lit(True), "code": F.lit(None).cast("binary")})
        old = live.select("a", "b", "d", F.lit(False).alias("fresh"), F.when(F.col("n") == 1, F.col("code")).alias("code"))
        better = materialize(_merged(found.unionByName(old), "fresh", degree))
        discard(edges)
        edges = better
        if edges.where("fresh").count() <= CHANGED * degree * count:
            break
    return edges.where("b IS NOT NULL").select("a", "b", "d")


@dataclass
class Graph:
    """A bucketed table (node, around) and its nodes (node, x, code, ids)."""

    name: str
    nodes: DataFrame
    width: int

    def read(self) -> DataFrame:
        return self.nodes.sparkSession.table(self.name)

    def drop(self) -> None:
        self.nodes.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.nodes)


def build(usable: DataFrame, k: int = K, degree: int = DEGREE, back: int = BACK, rounds: int = ROUNDS) -> Graph:
    """The graph of (vec_id, x). A node has the k + 1 smallest ids of its vector."""
    spark = usable.sparkSession
    nth = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    distinct = usable.withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("node", F.col("ids")[0])
    distinct = materialize(distinct)
    width = (distinct.agg(F.max(F.length("x"))).first()[0] or 8) // 8
    nodes = materialize(with_codes(distinct, "node", width).join(distinct.select("node", "ids"), "node"))
    edges = neighbour_graph(nodes, degree, back, rounds)
    chance = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a"))
    named = edges.withColumn("n", chance).where(F.col("n") <= back).select(F.col("b").alias("node"), F.col("a").alias("b"))
    both = edges.select(F.col("a").alias("node"), "b").unionByName(named).distinct()
    around = both.join(nodes.select(F.col("node").alias("b"), "code"), "b").groupBy("node").agg(F.collect_list(F.struct("b", "code")).alias("around"))
    name = f"forge_graph_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    around.repartition(parts, "node").write.bucketBy(parts, "node").sortBy("node").format("parquet").saveAsTable(name)
    discard(edges, distinct)
    return Graph(name, nodes, width)


def search(graph: Graph, queries: DataFrame, entries: DataFrame, k: int = K, reach: int = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (query_id, x) that begin at entries (query_id,
    node), any nodes of the graph; a query's own id is no result."""
    asked = materialize(with_codes(queries, "query_id", graph.width))
    first = entries.join(asked.select("query_id", F.col("code").alias("q")), "query_id").join(graph.nodes.select("node", "code"), "node")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = ((decode(batch.column("q")) - decode(batch.column("code"))) ** 2).sum(axis=1)
        return pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(d, pa.float32())], names=["a", "b", "d"])

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("around")
        at, flat = np.asarray(column.offsets), column.flatten()
        n = np.diff(at)
        q, who, far = np.repeat(decode(batch.column("q")), n, axis=0), np.repeat(np.asarray(batch.column("query_id")), n), np.repeat(np.asarray(batch.column("far")), n)
        d = ((decode(flat.field("code")) - q) ** 2).sum(axis=1)
        near = d < far
        return _nearest_of_batch(who[near], np.asarray(flat.field("b"))[near], d[near].astype(np.float32), reach)

    known = asked.select(F.col("query_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(float("inf")).cast("float").alias("d"), F.lit(False).alias("read"), "code")
    start = map_batches(first.select("query_id", "node", "q", "code"), measure, _EDGE).withColumns({"read": F.lit(False), "code": F.lit(None).cast("binary")})
    beam = materialize(_merged(start.unionByName(known), "read", reach).where("b IS NOT NULL"))
    while not beam.where("NOT read").isEmpty():
        todo = beam.where("NOT read").select(F.col("a").alias("query_id"), F.col("b").alias("node"), F.col("code").alias("q"), "far")
        met = map_batches(todo.join(graph.read(), "node").select("query_id", "q", "far", "around"), walk, _EDGE).withColumns({"read": F.lit(False), "code": F.lit(None).cast("binary")})
        old = beam.select("a", "b", "d", F.lit(True).alias("read"), F.when(F.col("n") == 1, F.col("code")).alias("code"))
        better = materialize(_merged(met.unionByName(old), "read", reach))
        discard(beam)
        beam = better

    best = beam.where(F.col("n") <= RANKED).select(F.col("a").alias("query_id"), F.col("b").alias("node"))
    pairs = best.join(asked.select("query_id", F.col("x").alias("q")), "query_id").join(graph.nodes.select("node", "x", "ids"), "node")
    width = graph.width

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = []
        for q, x in zip(batch.column("q").to_pylist(), batch.column("x").to_pylist(), strict=True):
            v = np.zeros((2, max(width, len(q) // 8)))
            v[0, : len(q) // 8], v[1, : len(x) // 8] = np.frombuffer(q), np.frombuffer(x)
            scores.append(float(np.sqrt(((v[0] - v[1]) ** 2).sum())))
        return pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(scores, pa.float64())], names=["query_id", "ids", "score"])

    scored = map_batches(pairs.select("query_id", "q", "x", "ids"), exact, "query_id long, ids array<long>, score double")
    found = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(asked, beam)
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", reach: int = REACH) -> DataFrame:
    """The k nearest of the rows that ``is_query`` (of ``vec_id``) selects; each begins at its own node."""
    usable = materialize(usable_vectors(vectors, id_col, vector_col))
    graph = build(usable, k)
    queries = usable.where(is_query).select(F.col("vec_id").alias("query_id"), "x")
    out = search(graph, queries, queries.join(graph.nodes.select("x", "node"), "x").select("query_id", "node"), k, reach)
    graph.drop()
    discard(usable)
    return out


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op12_nearest_neighbours": op12_nearest_neighbours}
