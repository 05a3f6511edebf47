"""Cross-entropy difference of two matched n-gram models over one vocabulary.

Both models are interpolated bigram models of the same form over the same words: the target
is counted on documents that are labelled good, the background on all documents. The
vocabulary is every word of the corpus, so the tables of words and of (previous, word)
bigrams grow with it. Words and hot bigrams go by 64-bit hashes, 0.1 colliding pairs expected
among two billion; the predecessors of one word by 48 bits, 0.002 among a million.

Tasks sum each document's bigrams and deal them, packed in chunks of documents, to buckets
by the second word; a bucket so sees a word's whole counts, as word, as predecessor and in
each bigram, works out the losses and sends sums by document back to the chunk. The number
of buckets grows with the corpus. Words above a share of the corpus are dealt by bigram
instead and their counts broadcast, bigrams above it are scored where they are read: at most
``HOT_SHARE`` of either, or one for every ``HOT_ROWS`` tokens.

A document's score is its mean per-token loss under the target minus that under the
background: lower is more like the target.

Defined cases: a null or empty text has no tokens and null losses; a repeated document
counts as often as it is there; a document with several labels is a target if one says so;
rows with a null id are background; without target documents both models are uniform and
background; other columns are ignored; an empty table gives no rows. Where a vocabulary size
is given, all but the most frequent words share ``CLASSES`` hashed classes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tasks_for

#: Classes of the words outside a vocabulary of given size.
CLASSES = 256
#: Weight of the shorter model where a word's successors were seen so many times.
MU, ALPHA = 8.0, 0.5
FLUSH_WORDS = 300_000
#: Tokens of a chunk of documents, and bigrams of a bucket on average.
CHUNK, BUCKET_ROWS = 1_000_000, 1_500_000
CHUNK_DOCS = 65_535
#: A word or bigram is hot above one part in HOT_SHARE of the tokens, or HOT_ROWS.
HOT_SHARE, HOT_ROWS = 2000, 1_000_000
START = np.uint64(xxhash.xxh64_intdigest(b" "))


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def vocabulary(docs: DataFrame, size: int) -> list[str]:
    """The most frequent words of all texts (a bounded list). Tasks count first, Spark adds up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) > FLUSH_WORDS:
                    yield flush(held)
                    held.clear()
        if held:
            yield flush(held)

    def flush(c: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


class Hashes(dict):
    """Word to hash, emptied where it grows; with ``known``, other words to their class's."""

    def __init__(self, known: list[str] | None):
        self.known = None if known is None else set(known)

    def __missing__(self, word: str) -> int:
        if len(self) > FLUSH_WORDS:
            self.clear()
        own = self.known is None or word in self.known
        # surrogates cannot be encoded strictly; no word holds a space, so no class is a word
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass") if own else b"class %d" % (zlib.crc32(word.encode()) % CLASSES))
        self[word] = h
        return h


class Chunk:
    """Documents with their tokens in a row: word, word before, document, whether the last."""

    def __init__(self, ids: list[int | None], goods: list[bool], tokens: list[np.ndarray]):
        self.ids = ids
        self.n = np.array([len(t) for t in tokens], np.int64)
        self.good = np.array(goods, bool)
        self.b = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(tokens), dtype=np.uint32), self.n)
        ends = np.cumsum(self.n)[self.n > 0]
        self.last = np.zeros(len(self.b), bool)
        self.last[ends - 1] = True
        self.a = np.r_[START, self.b[:-1]] if len(self.b) else self.b
        self.a[ends[:-1]] = START
        self.ab = self.a * np.uint64(0x9E3779B97F4A7C15) + self.b


def chunks(batches: Iterator[pa.RecordBatch], known: list[str] | None, most: int) -> Iterator[Chunk]:
    hashes, ids, goods, tokens, held = Hashes(known), [], [], [], 0
    for batch in batches:
        for i, good, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ws = words(text.as_py())
            ids.append(i)
            goods.append(good)
            tokens.append(np.array([hashes[w] for w in ws], np.uint64))
            held += len(ws) + 1
            if held >= most or len(ids) >= CHUNK_DOCS:
                yield Chunk(ids, goods, tokens)
                ids, goods, tokens, held = [], [], [], 0
    if ids:
        yield Chunk(ids, goods, tokens)


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, where each key is among them, and the sums of each weight."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at, [np.bincount(at, w, len(distinct)) for w in weights]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _count(rows: DataFrame, keys: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], known, most: int) -> DataFrame:
    """key, target, background and how many of them end a document (lt, lb), by hash."""
    names = ("target", "background", "lt", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, None if known is None else known.value, most):
            key, take = keys(c)
            good, last = c.good[c.row[take]], c.last[take]
            distinct, _, sums = _sums(key, good, np.ones(len(key)), good & last, last)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums)], names=["key", *names])

    return rows.mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names)).groupBy("key").agg(*(F.sum(n).alias(n) for n in names))


def _hot(counts: DataFrame, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys counted more often than ``above`` in order (so at most tokens / above), and their four sums."""
    got = counts.where(F.col("background") > above).toArrow()
    keys = got.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([got.column(n).to_numpy()[order] for n in ("target", "background", "lt", "lb")], np.float64).reshape(4, -1)


def _terms(two, one, last, n, ended, totals, size) -> list[np.ndarray]:
    """Sums of losses, target then background: of the bigram, and of its word as the next one's
    predecessor. Nats; the shorter model fills in by Dirichlet interpolation."""
    out = []
    for k in range(2):
        p1 = (one[k] + ALPHA) / (totals[k] + ALPHA * size)
        out.append(-n * np.log(two[k] + MU * p1) + (n - ended) * np.log(one[k] - last[k] + MU))
    return out


def cross_entropy_difference(docs: DataFrame, good: DataFrame, vocabulary_size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score."""
    context, most = docs.sparkSession.sparkContext, CHUNK
    known = None if vocabulary_size is None else context.broadcast(vocabulary(docs, vocabulary_size))  # of the size asked for
    marked = good.select(F.col("doc_id").alias("good_id")).where("good_id IS NOT NULL").distinct()
    # a merge join at every size: the list of target documents grows with the corpus
    joined = docs.select("doc_id", "text").join(marked.hint("merge"), F.col("doc_id") == F.col("good_id"), "left")
    rows = materialize(joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good_id").isNotNull().alias("good"), "text"))

    one = materialize(_count(rows, lambda c: (c.b, np.arange(len(c.b))), known, most))
    total = one.agg(F.count("*").alias("size"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("target", "background", "lt", "lb"))).first()
    size = total["size"] + 1 if known is None else len(known.value) + CLASSES + 1
    totals, starts = (total.target, total.background), (total.lt, total.lb)
    above = min(HOT_ROWS, total.background // HOT_SHARE)
    buckets = max(1, -(-total.background // BUCKET_ROWS))
    hot_words, hot_one = _hot(one, above)

    def hot_pairs(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """A bigram is no more frequent than its words; the start may stand before any."""
        take = np.flatnonzero(_found(hot_words, c.b)[0] & (_found(hot_words, c.a)[0] | (c.a == START)))
        return c.ab[take], take

    hot_keys, hot_two = _hot(_count(rows, hot_pairs, known, most), above)
    shared = context.broadcast((hot_words, hot_one, hot_keys, hot_two))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_one, hot_keys, hot_two = shared.value
        first = TaskContext.get().partitionId() << 32
        for k, c in enumerate(chunks(batches, None if known is None else known.value, most)):
            is_word, word = _found(hot_words, c.b)
            is_pair, pair = _found(hot_keys, c.ab)
            is_pair &= is_word
            sums = [np.where(c.n > 0, np.log(s + MU), 0.0) for s in starts]
            w, row = word[is_pair], c.row[is_pair]
            if len(w):
                parts = _terms(hot_two[:2, pair[is_pair]], hot_one[:2, w], hot_one[2:, w], 1, c.last[is_pair], totals, size)
                sums = [s + np.bincount(row, p, len(c.n)) for s, p in zip(sums, parts, strict=True)]
            head = np.array([i or 0 for i in c.ids], np.int64).tobytes() + np.array([i is not None for i in c.ids], np.uint8).tobytes()
            out = [(int(c.n.sum() + k) % buckets, 0, head + c.n.tobytes() + sums[0].tobytes() + sums[1].tobytes())]
            bucket = (np.where(is_word, c.ab ^ (c.ab >> np.uint64(31)), c.b) % np.uint64(buckets)).astype(np.int64)
            left = np.flatnonzero(~is_pair)
            left = left[np.lexsort((c.row[left], c.ab[left], c.b[left], bucket[left]))]
            bucket, b, ab, row, last = bucket[left], c.b[left], c.ab[left], c.row[left], c.last[left]
            if len(left):
                new = np.flatnonzero(np.r_[True, (ab[1:] != ab[:-1]) | (row[1:] != row[:-1]) | (b[1:] != b[:-1])])
                n, ended = np.diff(np.r_[new, len(ab)]).astype(np.uint32), np.add.reduceat(last, new, dtype=np.uint8)
                bucket, b, ab, row = bucket[new], b[new], ab[new], row[new]
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    runs = np.flatnonzero(np.r_[True, b[x + 1 : y] != b[x : y - 1]])
                    many, ends = np.flatnonzero(n[x:y] > 1), np.flatnonzero(ended[x:y])  # few of either
                    head = np.array([y - x, len(runs), len(many), len(ends)], np.uint32)
                    parts = (head, b[x:y][runs], ab[x:y].astype(np.uint32), (ab[x:y] >> np.uint64(32)).astype(np.uint16), np.diff(np.r_[runs, y - x]).astype(np.uint32), row[x:y].astype(np.uint16))
                    parts += (many.astype(np.uint32), n[x:y][many], ends.astype(np.uint32), np.packbits(c.good[row[x:y]]))
                    out.append((int(bucket[x]), 1, b"".join(p.tobytes() for p in parts)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array([first + k] * len(out), pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "chunk", "kind", "data"]
            )

    def unpack(data: bytes) -> tuple[np.ndarray, ...]:
        m, r, f, e = np.frombuffer(data, np.uint32, 4).tolist()
        at, got = 16, []
        for kind, k in ((np.uint64, r), (np.uint32, m), (np.uint16, m), (np.uint32, r), (np.uint16, m), (np.uint32, f), (np.uint32, f), (np.uint32, e), (np.uint8, -(-m // 8))):
            got.append(np.frombuffer(data, kind, k, at))
            at += got[-1].nbytes
        b, low, high, runs, row, many, times, ends, good = got
        b, n, ended = np.repeat(b, runs), np.ones(m), np.zeros(m, bool)
        n[many], ended[ends] = times, True
        # 48 bits of the bigram's hash tell a word's predecessors apart
        return b, (low | high.astype(np.uint64) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + b, row, n, ended, np.unpackbits(good, count=m)

    def lose(held: list[tuple[int, bytes]]) -> tuple[list[int], list[bytes]]:
        """Losses of a whole bucket, summed by document of each chunk."""
        hot_words, hot_one, _, _ = shared.value
        got = [unpack(data) for _, data in held]
        b, ab, _, n, ended, good = (np.concatenate(x) for x in zip(*got, strict=True))
        _, at2, two = _sums(ab, n * good, n)
        distinct, at1, one = _sums(b, n * good, n, ended * good, ended)
        is_hot, where = _found(hot_words, distinct)
        one = np.array(one)
        one[:, is_hot] = hot_one[:, where[is_hot]]
        t, u = _terms([x[at2] for x in two], one[:2, at1], one[2:, at1], n, ended, totals, size)
        names, out, at = [], [], 0
        for (chunk, _), part in zip(held, got, strict=True):
            y = at + len(part[1])
            row, _, sums = _sums(part[2], t[at:y], u[at:y])
            names.append(chunk)
            out.append(row.tobytes() + sums[0].tobytes() + sums[1].tobytes())
            at = y
        return names, out

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive whole and in order; documents' own rows pass."""

        def result(names: list[int], kind: int, out: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([kind] * len(names), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "kind", "data"])

        held, current = [], None
        for batch in batches:
            for bucket, chunk, kind, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 0:
                    yield result([chunk], 0, [data])
                    continue
                if bucket != current and held:
                    yield result(*(lambda r: (r[0], 1, r[1]))(lose(held)))
                    held = []
                current = bucket
                held.append((chunk, data))
        if held:
            yield result(*(lambda r: (r[0], 1, r[1]))(lose(held)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks arrive whole: the documents first, then sums from buckets."""

        def result(ids: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            t, u = sums / np.maximum(n, 1)
            none = n == 0
            return pa.RecordBatch.from_arrays([ids, pa.array(n), *(pa.array(x, mask=none) for x in (t, u, t - u))], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

        ids = None
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 0:
                    if ids is not None:
                        yield result(ids, n, sums)
                    m = len(data) // 33
                    ids = pa.array(np.frombuffer(data, np.int64, m), mask=np.frombuffer(data, np.uint8, m, 8 * m) == 0)
                    n = np.frombuffer(data[9 * m : 17 * m], np.int64)
                    sums = np.frombuffer(data[17 * m :], np.float64).reshape(2, m).copy()
                else:
                    m = len(data) // 18
                    row = np.frombuffer(data, np.uint16, m)
                    sums[:, row] += np.frombuffer(data[2 * m :], np.float64).reshape(2, m)
        if ids is not None:
            yield result(ids, n, sums)

    dealt = rows.mapInArrow(deal, "bucket int, chunk long, kind int, data binary").repartition(tasks_for(buckets, 1), "bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(losses, "chunk long, kind int, data binary").repartition("chunk").sortWithinPartitions("chunk", "kind")
    return back.mapInArrow(add_up, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op3_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


QUERIES = {"op3_lm_cross_entropy": op3_lm_cross_entropy}
