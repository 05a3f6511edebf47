"""Results of earlier runs as a table: keys, fresh lookups, upserts, purges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHECK_CACHE, present
from ..storage import delete, discard, keep

FAIL_DAYS, OTHER_DAYS = 1, 30


def identity(namespace: str) -> Column:
    """K1: what a reference's result is filed under; null: not filed. ``url`` rows have a url."""
    title = present(F.col("title"))
    if namespace == "url_liveness":
        return present(F.col("url"))
    if namespace == "relevance":
        return F.coalesce(present(F.col("doi")), F.concat(title, F.lit("|"), F.coalesce(F.get("urls", F.lit(0)), F.lit(""))))
    return F.coalesce(present(F.col("doi")), present(F.col("arxiv_id")), F.concat(title, F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("None"))))


def key(namespace: Column, identifier: Column) -> Column:
    return F.sha2(F.concat(namespace, F.lit(":"), identifier), 256)


def _fresh(now: Column) -> Column:
    age = F.unix_micros(now) - F.unix_micros("created_at")
    return age <= F.when(F.col("status") == "FAIL", FAIL_DAYS).otherwise(OTHER_DAYS) * F.lit(86_400_000_000)


def latest(cache: DataFrame) -> DataFrame:
    """The newest row of each key; of rows of one moment the largest."""
    rest = F.struct("created_at", "namespace", "identifier", "status", "confidence", "evidence")
    top = cache.where("key IS NOT NULL").groupBy("key").agg(F.max(rest).alias("m"))
    return top.select("m.namespace", "m.identifier", "key", "m.status", "m.confidence", "m.evidence", "m.created_at")


def lookup(wanted: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """K2: rows of ``wanted`` (with a key) that have a fresh result, and those that have none."""
    good = latest(cache).where(_fresh(now)).select("key", "status", "confidence", "evidence")
    return wanted.join(good, "key"), wanted.join(good.select("key"), "key", "left_anti")


def upsert(cache: DataFrame, results: DataFrame) -> DataFrame:
    """K3: the table with newer results in place of older ones."""
    return latest(cache.unionByName(results.select(cache.columns)))


def purge(cache: DataFrame, now: Column) -> DataFrame:
    """K4: without what is no longer fresh."""
    return latest(cache).where(_fresh(now))


#: Columns of a stored row; the slice comes from the key's first hexadecimal digits.
ROW = ["namespace", "identifier", "key", "status", "confidence", "evidence", "created_at"]


@dataclass(frozen=True)
class Store:
    """K2-K4 on a table of results at a path, one row a key, in folders by namespace and slice.

    A lookup reads the slices that wanted keys fall into. A merge reads and rewrites only the
    slices with changed keys, through a table of its own, so that a lost executor or an ended run
    leaves the old slices whole; two runs must not merge at the same time.
    """

    path: str
    slices: int = 256

    def _slice(self, key: Column) -> Column:
        return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(self.slices)).cast("int")

    def exists(self, spark: SparkSession) -> bool:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def read(self, spark: SparkSession) -> DataFrame:
        rows = f"{CHECK_CACHE}, slice int"
        return spark.read.schema(rows).parquet(self.path) if self.exists(spark) else spark.createDataFrame([], rows)

    def _touched(self, spark: SparkSession, keyed: DataFrame) -> list[tuple[str, int]]:
        """Folders of keys: at most namespaces x slices."""
        return [(r[0], r[1]) for r in keyed.select("namespace", self._slice(F.col("key")).alias("slice")).distinct().collect()]

    def _of(self, spark: SparkSession, touched: list[tuple[str, int]]) -> DataFrame:
        rows, here = self.read(spark), F.lit(False)
        for n in sorted({n for n, _ in touched}):
            here = here | ((F.col("namespace") == n) & F.col("slice").isin([s for m, s in touched if m == n]))
        return rows.where(here)

    def lookup(self, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        """K2: rows of ``wanted`` (with a key or null) with a fresh result, and those without."""
        fresh = self.read(wanted.sparkSession).where(_fresh(now)).select("key", "status", "confidence", "evidence")
        return wanted.join(fresh, "key"), wanted.join(fresh.select("key"), "key", "left_anti")

    def merge(self, results: DataFrame) -> int:
        """K3: newer results in place of older ones; how many slices were written."""
        spark = results.sparkSession
        new = keep(latest(results.where("key IS NOT NULL").select(*ROW)))
        touched = self._touched(spark, new)
        if touched:
            self._replace(latest(self._of(spark, touched).select(*ROW).unionByName(new)))
        discard(new)
        return len(touched)

    def purge(self, spark: SparkSession, now: Column) -> int:
        """K4: without what is no longer fresh; how many slices were touched. Slices in which
        nothing is fresh are deleted, as dynamic overwriting leaves folders without rows alone."""
        stale = self.read(spark).where(~_fresh(now))
        touched = self._touched(spark, stale)
        if touched:
            kept = keep(self._of(spark, touched))
            alive = kept.where(_fresh(now))
            self._replace(alive.select(*ROW))
            left = {(r[0], r[1]) for r in alive.select("namespace", "slice").distinct().collect()}
            for namespace, slice_ in touched:
                if (namespace, slice_) not in left:
                    delete(spark, f"{self.path}/namespace={namespace}/slice={slice_}")
            discard(kept)
        return len(touched)

    def _replace(self, rows: DataFrame) -> None:
        """Writes whole slices: of a table that is kept first, as the slices are read for it."""
        done = keep(rows.withColumn("slice", self._slice(F.col("key"))))
        done.repartition("namespace", "slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "slice").parquet(self.path)
        discard(done)
