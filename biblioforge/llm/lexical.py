"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are cut into terms once, into a table of counts that all that follows reads: the
corpus statistics (documents, terms, document frequencies), the weights, and the impact lists
of the terms that the items ask for. Documents are dealt into shards of bounded size, items
into blocks; a shard and a block meet in one group. There every term has its list of documents
by falling impact, and an item's lists are read by direct access to the first positions that
nothing has seen yet. A document that is met is scored whole, by looking up its place in all
lists of the item, and counts as seen in each of them. So a list's best position, up to which
all is seen, runs ahead of what was read from that list itself. No unseen document can score
above the sum of the impacts at the lists' first unseen positions; the search ends when that sum
is strictly below the k-th score, so that ties by id are right. Each shard's best k meet in
a ranking by item.

Defined cases: a null text has no terms; documents without a term count nowhere; rows without an
id take no part; each row of documents is a document of its own, also where ids repeat; a repeated
item id counts once, with its smallest text; items without a known term have no rows; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, table

K = 20
#: Documents of a shard and items of a block.
SHARD_DOCS, ITEM_BLOCK = 8192, 1024
#: UTF-8 bytes: A-Z to a-z, what separates terms to a blank; bytes of other characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COUNTS = "id long, n long, terms array<string>, tfs array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): how many terms a text has, its different terms and their counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, terms, tfs, at = [], [], [], [0]
        for text in batch.column(1).cast(pa.binary()):
            found = terms_of(text.as_py() or b"")
            counted = Counter(found)
            sizes.append(len(found))
            terms += counted
            tfs += counted.values()
            at.append(len(terms))
        offsets = pa.array(at, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, values) for values in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    usable = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(usable, run, COUNTS)


def _each(counts: DataFrame, *columns: str) -> DataFrame:
    """A row for each different term of a text."""
    return counts.select(*columns, F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(*columns, F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


class Lists:
    """Impact lists of a shard: each term's documents by falling gain, and where each document is."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, gain: np.ndarray):
        self.ids, doc = np.unique(doc, return_inverse=True)
        self.terms, term = np.unique(term, return_inverse=True)
        order = np.lexsort((doc, -gain, term))
        self.term, self.doc, self.gain = term[order], doc[order], gain[order]
        self.start = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        key = self.term * len(self.ids) + self.doc
        self.by_doc = np.argsort(key)
        self.key = key[self.by_doc]

    def places(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Positions of documents in lists, -1 where a list has not got one: terms x docs."""
        want = terms[:, None] * len(self.ids) + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.by_doc[at], -1)


def best_positions(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents (as numbers of the shard) and scores for the terms of an item with
    weights, and how many documents were scored."""
    start, end = lists.start[terms], lists.start[terms + 1]
    first = np.concatenate([[0], np.cumsum(end - start)])  # where a list begins among the flags
    seen = np.zeros(first[-1], bool)
    best = np.zeros(len(terms), np.int64)  # a list's first unseen position
    docs, scores, step, scored = np.empty(0, np.int64), np.empty(0, np.int64), k, 0
    while True:
        met = []
        for i in range(len(terms)):
            a = first[i] + best[i]
            at = np.flatnonzero(~seen[a : min(a + step, first[i + 1])])
            met.append(lists.doc[start[i] + best[i] + at])
        met = np.unique(np.concatenate(met))
        scored += len(met)
        place = lists.places(terms, met)
        held = place >= 0
        score = np.where(held, lists.gain[place], 0) * weights[:, None]
        seen[(place - start[:, None] + first[:-1, None])[held]] = True
        docs, scores = np.concatenate([docs, met]), np.concatenate([scores, score.sum(axis=0)])
        top = np.lexsort((lists.ids[docs], -scores))[:k]
        docs, scores = docs[top], scores[top]
        most = 0
        for i in range(len(terms)):
            rest = seen[first[i] + best[i] : first[i + 1]]
            ahead = int(rest.argmin()) if len(rest) else 0
            best[i] += len(rest) if len(rest) and rest[ahead] else ahead
            if start[i] + best[i] < end[i]:
                most += int(weights[i]) * int(lists.gain[start[i] + best[i]])
        if (best == end - start).all() or (len(scores) == k and most < scores[-1]):
            return docs, scores, scored
        step *= 2


def _search(k: int):
    """A shard's postings and a block's items to (item_id, doc_id, score)."""

    def run(postings: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"item_id": [], "doc_id": [], "score": []}, dtype="int64")
        if postings.empty or items.empty:
            return none
        lists = Lists(postings["term_id"].to_numpy(), postings["row"].to_numpy(), postings["gain"].to_numpy())
        row, first = np.unique(postings["row"].to_numpy(), return_index=True)
        lists.ids = postings["doc_id"].to_numpy()[first]
        out = [none]
        for item_id, asked in items.groupby("item_id"):
            at = np.searchsorted(lists.terms, asked["term_id"].to_numpy())
            known = lists.terms[np.minimum(at, len(lists.terms) - 1)] == asked["term_id"].to_numpy()
            if known.any():
                docs, scores, _ = best_positions(lists, at[known], asked["weight"].to_numpy()[known], k)
                out.append(pd.DataFrame({"item_id": item_id, "doc_id": lists.ids[docs], "score": scores}))
        found = pd.concat(out)
        return found[found["score"] > 0]

    return run


def ranked_search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of tables (doc_id, text) and (item_id, text)."""
    counts = materialize(term_counts(documents, "doc_id", "text").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    once = items.groupBy("item_id").agg(F.min("text").alias("text"))
    asked = _each(term_counts(once, "item_id", "text"), "id").withColumnRenamed("tf", "times")
    asked = materialize(asked)
    blocks = max(1, -(-asked.select("id").distinct().count() // ITEM_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    wanted = materialize(asked.select("term", "block").distinct().withColumn("term_id", F.monotonically_increasing_id()))

    # whether the asked terms are small enough to broadcast is Spark's to measure
    postings = _each(counts, "id", "row", "n").join(wanted, "term").select("block", "term_id", "row", F.col("id").alias("doc_id"), "n", "tf")
    postings = materialize(postings)
    df = postings.groupBy("block", "term_id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(df.select("term_id", weight.alias("w")))
    m = F.lit(100 - 25) + F.expr(f"(25 * n * {total.docs}L) div {max(total.terms, 1)}L")
    gain = F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")

    shards = max(1, -(-total.docs // SHARD_DOCS))
    dealt = postings.withColumn("m", m).select("block", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "term_id", "row", "doc_id", gain.alias("gain"))
    weighed = asked.join(wanted, ["term", "block"]).join(weights, "term_id").select("block", F.col("id").alias("item_id"), "term_id", (F.col("w") * F.col("times")).alias("weight"))
    each = weighed.where("weight > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = dealt.groupBy("block", "shard").cogroup(each.groupBy("block", "shard")).applyInPandas(_search(k), "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    out = materialize(met.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    discard(counts, asked, wanted, postings, weights)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents WHERE doc_id IS NOT NULL) WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), total),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), total GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": ORACLE_SQL}
