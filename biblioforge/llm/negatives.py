"""Hard negatives by rotated one-bit codes with deterministic intervals.

A vector is rotated at random and cut to its signs; with it goes its alignment, the length of its
projection on the code's direction. What the projection leaves is rotated and cut again, so
that ``LEVELS`` codes leave a residual of known length that is orthogonal to the last code. An
anchor is rotated alike and cut into bit planes; popcounts of a plane and a code give the
products with the codes, up to the planes' rounding, whose length is known too. By the
inequality of Cauchy and Schwarz the exact product then lies in an interval around the estimate:
what is left of the vector times what is left of the anchor, and the rounding times the
alignments. Only candidates whose interval reaches the band that is asked for, and
the k-th best lower end in it, are scored in integers.

Positives meet their anchors by label, negatives all anchors; both in blocks of bounded size, and
frequent labels are many blocks. Every block's best go into one ranking.

Defined cases: rows without an id, with a null label, a null vector or null or non-finite
components take no part; a repeated id counts once, with its smallest label and vector; shorter
vectors are filled up with zeros; ties go to the smaller id; a band of negative scores is empty;
an empty table gives no rows; other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Bounds of a negative's score in hundredths of its positive's.
LOWEST, HIGHEST = 30, 90
LEVELS, PLANES = 8, 8
ANCHOR_BLOCK, BLOCK, AT_ONCE = 2048, 8192, 64


def labelled(rows: DataFrame, label: Column, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v): vectors in integers, as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, out = [], []
        for i, v in enumerate(batch.column(2).to_pylist()):
            if v is None or any(c is None for c in v):
                continue
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                keep.append(i)
                out.append(np.floor(x * scale).astype(np.int64).tobytes())
        first = batch.take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([first.column(0).cast(pa.int64()), first.column(1).cast(pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    usable = rows.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL")
    once = map_batches(usable, run, "vec_id long, label long, v binary").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s"))
    return once.select("vec_id", "s.label", "s.v")


@functools.cache
def rotations(width: int, levels: int) -> np.ndarray:
    """A fixed random rotation for each level."""
    rng = np.random.default_rng(width)
    return np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(levels)])


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, np.int64)
        out[i, : len(x)] = x
    return out


def encode(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x levels x bytes), alignments (rows x levels) and lengths of the residuals."""
    rest = v.astype(np.float64)
    width = rest.shape[1]
    codes, along = [], []
    for turn in rotations(width, levels):
        rest = rest @ turn.T
        sign = np.where(rest >= 0, 1.0, -1.0)
        a = (rest * sign).sum(axis=1) / np.sqrt(width)
        rest = rest - a[:, None] / np.sqrt(width) * sign
        codes.append(np.packbits(sign > 0, axis=1, bitorder="little"))
        along.append(a)
    return np.stack(codes, axis=1), np.stack(along, axis=1), np.sqrt((rest * rest).sum(axis=1))


def coded(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, v, code, along, rest)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, along, rest = encode(matrix([v.as_py() for v in batch.column("v")], width))
        cells = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, cells(codes), cells(along), pa.array(rest)], names=["vec_id", "label", "v", "code", "along", "rest"])

    return map_batches(rows.select("vec_id", "label", "v"), run, "vec_id long, label long, v binary, code binary, along binary, rest double")


def intervals(anchors: np.ndarray, codes: np.ndarray, along: np.ndarray, rest: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the products of anchors with coded vectors: anchors x vectors."""
    q = anchors.astype(np.float64)
    width, levels = q.shape[1], along.shape[1]
    root = np.sqrt(width)
    words = codes.view(np.uint64)  # rows x levels x words
    norm2 = (q * q).sum(axis=1)
    middle, half, last = np.zeros((len(q), len(rest))), np.zeros((len(q), len(rest))), None
    for level, turn in enumerate(rotations(width, levels)):
        q = q @ turn.T
        low = q.min(axis=1)
        step = np.maximum((q.max(axis=1) - low) / (2**planes - 1), 1e-300)
        u = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
        rounded = low[:, None] + step[:, None] * u
        error = np.sqrt(((q - rounded) ** 2).sum(axis=1))
        held = words[:, level]
        ones = np.bitwise_count(held).sum(axis=1, dtype=np.int64)
        tally = np.zeros(middle.shape, np.int64)
        for j in range(planes):
            plane = np.packbits((u >> j & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)
            for w in range(plane.shape[1]):
                tally += np.bitwise_count(plane[:, w, None] & held[None, :, w]).astype(np.int64) << j
        product = (2 * (low[:, None] * ones + step[:, None] * tally) - rounded.sum(axis=1)[:, None]) / root
        middle += along[:, level] * product
        half += np.abs(along[:, level]) * error[:, None]
        last = np.maximum(np.abs(product) - error[:, None], 0)
    half += rest * np.sqrt(np.maximum(norm2[:, None] - last * last, 0))
    half = half * (1 + 1e-9) + 1e-9 * np.sqrt(norm2)[:, None] * (np.abs(along).sum(axis=1) + rest) + 1e-6  # of the arithmetic
    return middle - half, middle + half


def _unpack(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), LEVELS, width // 8)
    along = np.frombuffer(b"".join(rows["along"]), np.float64).reshape(len(rows), LEVELS)
    return matrix(rows["v"], width), codes, along, rows["rest"].to_numpy()


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _blocked(anchors: DataFrame, rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns a and c: blocks of bounded size that meet one another, within equal ``by``."""
    n, m = rows.groupBy(*by).agg(F.count("*").alias("nc")), anchors.groupBy(*by).agg(F.count("*").alias("na"))
    if by:
        sizes = n.join(m, by)
        sized = lambda t: t.join(sizes, by)
    else:
        nc, na = n.first()[0], m.first()[0]
        sized = lambda t: t.withColumns({"nc": F.lit(nc), "na": F.lit(na)})
    count = lambda name, size: F.greatest(F.lit(1), F.ceil(F.col(name) / size).cast("int"))
    own = lambda id_, name, size: F.pmod(F.xxhash64(id_), count(name, size)).cast("int")
    every = lambda name, size: F.explode(F.sequence(F.lit(0), count(name, size) - 1))
    a = sized(anchors).withColumn("a", own("anchor_id", "na", ANCHOR_BLOCK)).withColumn("c", every("nc", BLOCK))
    c = sized(rows).withColumn("c", own("vec_id", "nc", BLOCK)).withColumn("a", every("na", ANCHOR_BLOCK))
    return a.drop("na", "nc"), c.drop("na", "nc")


def positives_of(anchors: DataFrame, rows: DataFrame, width: int, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first k other rows of the anchor's label."""

    def meet(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            v, codes, along, rest = _unpack(c, width)
            ids, asked, asking = c["vec_id"].to_numpy(), matrix(a["anchor_v"], width), a["anchor_id"].to_numpy()
            for s in range(0, len(a), AT_ONCE):
                low, high = intervals(asked[s : s + AT_ONCE], codes, along, rest)
                for i, q in enumerate(asking[s : s + AT_ONCE]):
                    other = ids != q
                    left = np.flatnonzero(other & (high[i] >= _kth(low[i][other], k)))
                    score = v[left] @ asked[s + i]
                    top = np.lexsort((ids[left], -score))[:k]
                    out.append(pd.DataFrame({"anchor_id": q, "positive_id": ids[left[top]], "positive_score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="int64")

    a, c = _blocked(anchors, rows, ["label"])
    keys = ["label", "a", "c"]
    found = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("n", rank).where(F.col("n") <= k).drop("n")


def survivors(label: int, others: np.ndarray, low: np.ndarray, high: np.ndarray, bands: list[tuple[int, int]], k: int) -> np.ndarray:
    """Vectors of other labels whose interval can hold one of the k best scores of a band."""
    left = np.zeros(len(low), bool)
    for least, most in bands:
        if least <= most:
            reach = (others != label) & (high >= least) & (low <= most)
            sure = low[reach & (low >= least) & (high <= most)]
            left |= reach & (high >= _kth(sure, k))
    return np.flatnonzero(left)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, v) that ``is_anchor`` selects."""
    rows = materialize(rows)
    longest = (rows.agg(F.max(F.length("v"))).first()[0] or 0) // 8
    width = max(64, -(-longest // 64) * 64)
    all_ = materialize(coded(rows, width))
    anchors = all_.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), (F.col("label") + 0).alias("label"), F.col("v").alias("anchor_v"))
    found = materialize(positives_of(anchors, all_, width, positives))
    asked = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wanted"))
    asked = anchors.withColumnRenamed("label", "anchor_label").join(asked, "anchor_id")

    def meet(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            v, codes, along, rest = _unpack(c, width)
            ids, labels, vectors = c["vec_id"].to_numpy(), c["label"].to_numpy(), matrix(a["anchor_v"], width)
            asking = list(a[["anchor_id", "anchor_label", "wanted"]].itertuples(index=False))
            for s in range(0, len(a), AT_ONCE):
                low, high = intervals(vectors[s : s + AT_ONCE], codes, along, rest)
                for i, (q, label, wanted) in enumerate(asking[s : s + AT_ONCE]):
                    # whole numbers n with LOWEST * p <= 100 * n <= HIGHEST * p
                    bands = [(-(-LOWEST * w["positive_score"] // 100), HIGHEST * w["positive_score"] // 100) for w in wanted]
                    left = survivors(label, labels, low[i], high[i], bands, negatives)
                    score = v[left] @ vectors[s + i]
                    order = np.lexsort((ids[left], -score))
                    for w, (least, most) in zip(wanted, bands, strict=True):
                        top = order[(score[order] >= least) & (score[order] <= most)][:negatives]
                        if len(top):
                            out.append(pd.DataFrame({"anchor_id": q, "positive_id": w["positive_id"], "negative_id": ids[left[top]], "positive_score": w["positive_score"], "negative_score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")}, dtype="int64")

    a, c = _blocked(asked, all_, [])
    met = a.groupBy("a", "c").cogroup(c.groupBy("a", "c")).applyInPandas(meet, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = materialize(met.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(rows, all_, found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(labelled(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same) WHERE n <= 5
), n AS (
  SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": ORACLE_SQL}
