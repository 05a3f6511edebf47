"""Toxicity by maximum-scoring segments.

A lexicon of word features gets log-odds between toxic and clean documents under an
informative Dirichlet prior (the pooled counts). A linear scan over a text's token scores
finds all maximal-scoring segments; a segment's significance follows extreme-value
statistics (expected chance segments E = K n exp(-lambda s)), the segments of a document are
joined by their normalized scores, and a two-parameter logistic map turns that into 0 to 1.

The fit reads a bounded sample of labelled rows (``FIT_ROWS``, smallest hashes of doc_id);
scoring reads every whole text. What travels to the tasks is the lexicon: the features of the
sample that pass the tests of significance.

Defined cases: a null or empty text, or one without letters, has no segments and scores as
such; rows with a null id are scored and never fitted on; several labels of a document count
as toxic if one does, null labels not at all; without labels of both kinds every score is
the share of toxic labels (0 without any); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, table

#: Bound: labelled rows that are fitted on. It bounds the lexicon, too.
FIT_ROWS = 20_000
#: Toxic documents that must hold a feature; z-score and log-odds that it needs; the priors'
#: weights, in tokens and as a share of the documents. A word comes in bursts, so z is of documents.
MIN_TOXIC_DOCS, MIN_Z, MIN_LOG_ODDS, PRIOR_TOKENS, PRIOR_SHARE = 5, 3.5, 2.0, 2_000.0, 0.125
PREFIXES = (4, 5, 6)
#: Segments with fewer expected chance finds than this are passages.
MAX_E = 0.05
TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def features(token: str) -> list[str]:
    """The word and its shorter beginnings, longest first; beginnings end in a dash."""
    return [token, *(token[:n] + "-" for n in reversed(PREFIXES) if len(token) > n)]


@dataclass(frozen=True)
class Model:
    """Weights, background drift, extreme-value parameters and the logistic map."""

    weights: dict[str, float]
    drift: float
    log_k: float
    lam: float
    bias: float
    slope: float

    @property
    def heads(self) -> frozenset[str]:
        return frozenset(f.rstrip("-")[:4] for f in self.weights)


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of the sequence whose
    tokens score ``drift`` (below 0) but for the listed hits (above 0). Linear: each run of
    drift counts as one negative score, each candidate is merged at most once."""
    cand: list[list[float]] = []  # first, last, sum before, sum up to its end, index of the nearest earlier one with a smaller sum before
    total, before = 0.0, -1
    for at, w in hits:
        total += drift * (at - before - 1)
        before = at
        new = [at, at, total, total + w]
        total += w
        while True:
            j = len(cand) - 1
            while j >= 0 and cand[j][2] >= new[2]:
                j = int(cand[j][4])
            if j < 0 or cand[j][3] >= new[3]:
                cand.append([*new, j])
                break
            new = [cand[j][0], new[1], cand[j][2], new[3]]
            del cand[j:]
    return [(int(c[0]), int(c[1]), c[3] - c[2]) for c in cand]


class Scorer:
    """A model with a memo of token weights."""

    def __init__(self, model: Model):
        self.model, self.heads, self.memo = model, model.heads, {}

    def weight(self, token: str) -> float:
        if (w := self.memo.get(token)) is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            w = self.memo[token] = next((self.model.weights[f] for f in features(token) if f in self.model.weights), 0.0)
        return w

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Token count and the significant segments: first, last, score, ln E."""
        toks, heads = tokens(text), self.heads
        hits = [(i, w) for i, t in enumerate(toks) if t[:4] in heads and (w := self.weight(t)) > 0]
        m = self.model
        found = [(a, b, s, m.log_k + math.log(len(toks)) - m.lam * s) for a, b, s in maximal_segments(hits, m.drift)] if hits else []
        return len(toks), [p for p in found if p[3] <= math.log(MAX_E)]

    def evidence(self, passages: list[tuple[int, int, float, float]]) -> float:
        """Joint normalized score of the passages, damped so that long texts do not run away."""
        return math.log1p(sum(-p[3] for p in passages))

    def score(self, evidence: float) -> float:
        x = self.model.bias + self.model.slope * evidence
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of the bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.struct(F.xxhash64("doc_id"), "doc_id", F.md5("text")).alias("at"))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The smallest hash of five tokens: copies and most near copies share it, and count once."""
        marks = []
        for text in batch.column(0).to_pylist():
            t = tokens(text)
            marks.append(min(xxhash.xxh3_64_intdigest(" ".join(t[i : i + 5])) >> 1 for i in range(max(1, len(t) - 4))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=["text", "toxic", "at", "mark"])

    signed = map_batches(rows, sign, f"text string, toxic int, at {rows.schema['at'].dataType.simpleString()}, mark long")
    return signed.groupBy("mark", "toxic").agg(F.min_by("text", "at").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = materialize(training_rows(docs, labels, fit_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences and toxic documents of each feature, summed over a batch."""
        for batch in batches:
            occur, seen = (Counter(), Counter()), (Counter(), Counter())
            n, rows_of = [0, 0], [0, 0]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                toks, y = tokens(text), int(toxic > 0)
                own = Counter(f for t in toks for f in features(t))
                occur[y].update(own)
                n[y] += len(toks)
                rows_of[y] += 1
                seen[y].update(own.keys())
            for y in (0, 1):  # the empty feature counts all tokens and documents
                occur[y][""], seen[y][""] = n[y], rows_of[y]
            keys = list(occur[0].keys() | occur[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), *(pa.array([c[k] for k in keys], pa.int64()) for c in (*occur, *seen))], names=["feature", "clean", "toxic", "clean_docs", "docs"]
            )

    counts = rows.mapInArrow(count, "feature string, clean long, toxic long, clean_docs long, docs long").groupBy("feature")
    counts = counts.agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "clean_docs", "docs")))
    counts = materialize(counts.where((F.col("docs") >= MIN_TOXIC_DOCS) | (F.col("feature") == "")))
    totals = counts.where("feature = ''").first()
    if totals is None or not totals.toxic or not totals.clean:
        share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
        return Model({}, -1.0, 0.0, 1.0, math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -800.0), 0.0)
    nt, nc, dt, dc = (float(x) for x in (totals.toxic, totals.clean, totals.docs, totals.clean_docs))

    def log_odds(a: str, b: str, na: float, nb: float, strength: float) -> tuple[F.Column, F.Column]:
        """Difference of log-odds under a prior in proportion to the pooled counts, and its z."""
        k, m = F.col(a).cast("double"), F.col(b).cast("double")
        prior = (k + m) * (strength / (na + nb))
        x, y = (F.log((c + prior) / F.greatest(F.lit(0.5), n + strength - c - prior)) for c, n in ((k, F.lit(na)), (m, F.lit(nb))))
        return x - y, (x - y) / F.sqrt(1 / (k + prior) + 1 / (m + prior))

    delta, z = log_odds("toxic", "clean", nt, nc, PRIOR_TOKENS)[0], log_odds("docs", "clean_docs", dt, dc, PRIOR_SHARE * (dt + dc))[1]
    passing = counts.where("feature <> ''").select("feature", "toxic", "clean", delta.alias("delta"), z.alias("z")).where((F.col("delta") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z))
    found = passing.orderBy("feature").collect()  # features of the bounded sample
    weights = {r.feature: r.delta for r in found}
    chance = sum(r.clean for r in found)
    rate_c = (chance + 0.5) / (nc + 1)
    # drift: log-odds of a token outside the lexicon
    toxic_hits = sum(r.toxic for r in found if not r.feature.endswith("-")) + 0.5
    drift = min(-1e-4, math.log((1 - min(0.9, toxic_hits / nt)) / (1 - rate_c)))
    lam = _lambda(rate_c, float(np.mean(list(weights.values()))) if weights else 1.0, drift)
    log_k = math.log(rate_c) + lam * (min(weights.values()) if weights else 0.0)
    model = Model(weights, drift, log_k, lam, 0.0, 1.0)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Scorer(model)
        x = [s.evidence(s.passages(t)[1]) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.round(x, 1)), pa.array([int(y > 0) for y in batch.column(1).to_pylist()], pa.int64())], names=["x", "y"])

    points = map_batches(rows, evidence, "x double, y long").groupBy("x", "y").count().collect()  # tenths of a logarithm: a few hundred rows
    bias, slope = _logistic(np.array([[p.x, p.y, p["count"]] for p in points], float))
    return Model(weights, drift, log_k, lam, bias, slope)


def _lambda(rate: float, gain: float, drift: float) -> float:
    """The positive root of rate * exp(l gain) + (1 - rate) * exp(l drift) = 1."""
    low, high = 1e-6, 50.0
    f = lambda x: math.log(rate) + x * gain if x * gain > 600 else math.log(rate * math.exp(x * gain) + (1 - rate) * math.exp(x * drift))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return min(high, 20.0)


def _logistic(points: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton steps; the slope is not negative."""
    x = np.c_[np.ones(len(points)), points[:, 0]]
    y, w, b = points[:, 1], points[:, 2], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * np.array([0, b[1]])
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag([1e-6, ridge])
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the significant passages of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Scorer(model)
        scores, found = [], []
        for t in batch.column(1):
            _, ps = s.passages(t.as_py())
            scores.append(s.score(s.evidence(ps)))
            found.append([{"first": a, "last": b, "score": v, "log_e": e} for a, b, v, e in ps])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, score double, passages array<struct<first: long, last: long, score: double, log_e: double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (any columns, a text) that score below a threshold."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        s = Scorer(model)
        return pd.Series([s.score(s.evidence(s.passages(t)[1])) for t in texts], dtype="float64")

    return docs.where(score("text") < threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )


QUERIES = {"op1_toxicity": op1_toxicity}
