"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to the nearest of a bounded number of centers; each center's cell is cut into
blocks of bounded size. A query first meets the blocks of its own cell, which gives it a k-th
score that it cannot end below. Then it meets the cells that its bound, from its product with the
center and the cell's radius, does not exclude. Each pair of a query block and a candidate block is a
task of its own. Inside, both sides get a cover tree (nested centers, covering radii that halve),
and a pair of nodes is pruned when its bound, from the centers' product and both radii, is
below the worst k-th score of the query node. What remains is scored exactly in integers.
Of equal vectors in a block only the k + 1 smallest ids can be in any result, so only those
enter the tree.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without
an id take no part; a repeated id counts once, with its smallest vector; shorter vectors are
filled up with zeros; ties go to the smaller id; other columns are ignored; with fewer
candidates than k all are returned; an empty table gives no rows. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table

K, SCALE = 20, 64
QUERY_BLOCK, CANDIDATE_BLOCK, LEAF = 2048, 8192, 128
#: Centers at most; they and a row for each cell are all that the driver holds.
CENTERS = 1024
#: Centers of a net, and the points that stay one leaf where so few centers cannot halve the radius.
NET, SPREAD_LEAF = 16, 1024


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): usable vectors as integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or v is None or any(c is None for c in v):
                continue
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                out.append(np.floor(x * scale).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["vec_id", "x"])

    rows = map_batches(vectors.select(id_col, vector_col), run, "vec_id long, x array<long>")
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


class CoverTree:
    """Nodes as arrays: center, covering radius, and either children or a slice of points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []
        if len(points):
            members = np.arange(len(points))
            far = self._distance(0, members)
            self.root = self._build(0, members, far, leaf)

    def _distance(self, c: int, members: np.ndarray) -> np.ndarray:
        d = self.points[members] - self.points[c]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, center: int, members: np.ndarray, dist: np.ndarray, leaf: int) -> int:
        me, radius = len(self.center), float(dist.max())
        self.center.append(center)
        self.radius.append(radius)
        self.children.append([])
        self.members.append(None)
        if len(members) <= leaf or radius == 0:
            self.members[me] = members
            return me
        # a net of half the radius: the center, then always the point farthest from all before
        near, owner, centers = dist.copy(), np.zeros(len(members), np.int64), [center]
        while near.max() > radius / 2 and len(centers) < NET:
            c = int(members[int(near.argmax())])
            d = self._distance(c, members)
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centers)
            centers.append(c)
        parts = [(c, members[owner == k], near[owner == k]) for k, c in enumerate(centers)]
        spread = near.max() > radius / 2 and len(members) <= SPREAD_LEAF  # as in many dimensions
        if spread or max(len(m) for _, m, _ in parts) == len(members):
            self.members[me] = members
            return me
        self.children[me] = [self._build(c, m, d, leaf) for c, m, d in parts]
        return me


def _margin(x: float) -> float:
    return 1e-9 * abs(x) + 1e-6


def dual_tree(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and scores of its k best points (-1 where there are fewer)."""
    n = len(queries)
    top_id, top = np.full((n, k), -1, np.int64), np.full((n, k), np.iinfo(np.int64).min)
    if not n or not len(points):
        return top_id, top
    qt, ct = CoverTree(queries.astype(np.float64)), CoverTree(points.astype(np.float64))
    q_norm, c_norm = (np.sqrt(np.einsum("ij,ij->i", t.points, t.points)) for t in (qt, ct))
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1]
    exact_float = largest < 2**52
    worst_of = np.full(len(qt.center), -np.inf)
    parent = {c: p for p, kids in enumerate(qt.children) for c in kids}

    def bound(a: int, b: int) -> float:
        qa, cb = qt.center[a], ct.center[b]
        return float(qt.points[qa] @ ct.points[cb]) + qt.radius[a] * c_norm[cb] + ct.radius[b] * q_norm[qa] + qt.radius[a] * ct.radius[b]

    def leaf_pair(a: int, b: int) -> None:
        qi, ci = qt.members[a], ct.members[b]
        if exact_float:
            s = (qt.points[qi] @ ct.points[ci].T).astype(np.int64)
        else:
            s = queries[qi] @ points[ci].T
        s[query_ids[qi][:, None] == ids[ci][None, :]] = np.iinfo(np.int64).min
        live = np.flatnonzero((s >= top[qi, -1][:, None]).any(axis=1))
        if not len(live):
            return
        rows = qi[live]
        score = np.concatenate([top[rows], s[live]], axis=1)
        who = np.concatenate([top_id[rows], np.broadcast_to(ids[ci], (len(live), len(ci)))], axis=1)
        who = np.where(score == np.iinfo(np.int64).min, np.iinfo(np.int64).max, who)
        best = np.lexsort((who, -score.astype(np.float64) if exact_float else ~score), axis=1)[:, :k]
        top[rows] = np.take_along_axis(score, best, axis=1)
        found = np.take_along_axis(who, best, axis=1)
        top_id[rows] = np.where(found == np.iinfo(np.int64).max, -1, found)
        low = top[qi, -1].min()
        worst_of[a] = -np.inf if low == np.iinfo(np.int64).min else float(low)
        while a in parent:  # a node's worst is that of its worst child
            a = parent[a]
            low = min(worst_of[c] for c in qt.children[a])
            if low == worst_of[a]:
                break
            worst_of[a] = low

    stack = [(qt.root, ct.root, bound(qt.root, ct.root))]
    while stack:
        a, b, most = stack.pop()
        if most + _margin(most) < worst_of[a]:
            continue
        ka, kb = qt.children[a], ct.children[b]
        if not ka and not kb:
            leaf_pair(a, b)
            continue
        split_q = bool(ka) and (not kb or qt.radius[a] > ct.radius[b])
        pairs = [(x, b) for x in ka] if split_q else [(a, y) for y in kb]
        stack += sorted(((x, y, bound(x, y)) for x, y in pairs), key=lambda p: p[2])
    return top_id, top


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return _matrix(column.to_pylist(), width).astype(np.float64)


def _placed(centers: list[list[int]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Each vector's nearest center, and how far away it is."""
    longest = max(map(len, centers), default=0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        width = max(longest, max(map(len, batch.column(1).to_pylist()), default=0))
        x, c = _floats(batch.column(1), width), _matrix(centers, width).astype(np.float64)
        near = np.concatenate([(((c * c).sum(axis=1) - 2 * x[s : s + 1024] @ c.T).argmin(axis=1)) for s in range(0, len(x), 1024)])
        away = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["vec_id", "x", "cell", "away"])

    return run


def _other_cells(centers: list[list[int]], radius: dict[int, float]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A row for each query and each cell but its own that can hold a score of its k-th or more."""
    cells = np.array(sorted(radius))
    far, longest = np.array([radius[c] for c in sorted(radius)]), max(map(len, centers), default=0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        width = max(longest, max(map(len, batch.column(1).to_pylist()), default=0))
        x, c = _floats(batch.column(1), width), _matrix([centers[i] for i in cells], width).astype(np.float64)
        most = x @ c.T + far[None, :] * np.sqrt((x * x).sum(axis=1))[:, None]
        least = np.array([-np.inf if v is None else v for v in batch.column(4).to_pylist()], np.float64)
        i, j = np.nonzero((most + 1e-9 * np.abs(most) + 1e-6 >= least[:, None]) & (cells[None, :] != np.asarray(batch.column(2))[:, None]))
        at = pa.array(i)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells[j].astype(np.int32)), batch.column(3).take(at)], names=["vec_id", "x", "cell", "q"])

    return run


def exact_top_k(vectors: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` (of ``vec_id``) selects."""
    usable = materialize(scaled(vectors, id_col, vector_col))
    n, m = usable.count(), usable.where(is_query).count()
    cells = max(1, min(-(-n // CANDIDATE_BLOCK), CENTERS))
    chosen = [r.x for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).collect()]
    placed = materialize(map_batches(usable, _placed(chosen), "vec_id long, x array<long>, cell int, away double"))
    discard(usable)
    sizes = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    blocks = F.create_map(*(F.lit(v) for c, r in sizes.items() for v in (c, -(-r.n // CANDIDATE_BLOCK)))) if sizes else F.create_map().cast("map<int, int>")
    qb = max(1, -(-m // QUERY_BLOCK))
    deal = lambda count: F.pmod(F.xxhash64("vec_id"), count).cast("int")
    queries, own = placed.where(is_query).withColumn("q", deal(F.lit(qb))), F.col("cell")
    each = F.explode(F.sequence(F.lit(0), blocks[own] - 1)).alias("c")
    rows = ["vec_id", "x", "cell", "q", "c"]

    def meet(asking: DataFrame) -> DataFrame:
        """Queries (with the cells that they ask) and the blocks of those cells."""
        asked = asking.select("vec_id", "x", "cell", "q", each).withColumn("asks", F.lit(True))
        wanted = asking.select("cell", "q").distinct()
        given = placed.withColumn("c", deal(blocks[own])).join(wanted, "cell").select(*rows).withColumn("asks", F.lit(False))
        return asked.unionByName(given).groupBy("cell", "q", "c").applyInPandas(search, "query_id long, vec_id long, score long")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        width = max(len(v) for v in pdf["x"])
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        x = _matrix(b["x"], width)
        if len(x):
            nth = pd.Series([r.tobytes() for r in x]).pipe(lambda s: s.groupby(s).cumcount()).to_numpy()
            b, x = b[nth <= k], x[nth <= k]
        ids, scores = dual_tree(a["vec_id"].to_numpy(), _matrix(a["x"], width), b["vec_id"].to_numpy(), x, k)
        who = np.repeat(a["vec_id"].to_numpy(), k)
        out = pd.DataFrame({"query_id": who, "vec_id": ids.ravel(), "score": scores.ravel()})
        return out[(out["score"] != np.iinfo(np.int64).min).to_numpy()]

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = materialize(meet(queries).withColumn("rank", rank).where(F.col("rank") <= k))
    found = first.drop("rank")
    if len(sizes) > 1:
        least = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        rest = map_batches(queries.join(least, "vec_id", "left").select("vec_id", "x", "cell", "q", "least"), _other_cells(chosen, {c: r.radius for c, r in sizes.items()}), "vec_id long, x array<long>, cell int, q int")
        found = found.unionByName(meet(materialize(rest)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op9_exact_topk": op9_exact_topk}
ORACLES = {"op9_exact_topk": ORACLE_SQL}
