"""The catalog's identifiers as tables in buckets, written once and read by every run.

One work a source and key, and of a landing page's works the first; all dealt by key, so that a
lookup shuffles the references only. Where few references are looked up, Spark's own runtime
filter (a Bloom filter of their keys) cuts the scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import present
from ..storage import delete, forget_bucketed, read_bucketed, shared_path, write_bucketed

_DDL = {k: "key STRING, source STRING, work_id STRING" for k in ("doi", "arxiv_id", "pmid")} | {"url": "key STRING, source_priority INT, work_id STRING, source STRING"}
LAST = 2**31 - 1


def _key(kind: str) -> Column:
    return {"doi": X.doi_key, "arxiv_id": X.arxiv_key, "pmid": present}[kind](F.col(kind))


def keys_of(catalog: DataFrame, kind: str, named: Iterable[str] | None = None) -> DataFrame:
    """(key, source, work_id): the first work of each source that has a key."""
    rows = catalog if named is None else catalog.where(F.col("source").isin(*named))
    return rows.select("source", _key(kind).alias("key"), "work_id").where("key IS NOT NULL").groupBy("key", "source").agg(F.min("work_id").alias("work_id"))


def pages_of(catalog: DataFrame) -> DataFrame:
    """(key, source_priority, work_id, source): the first work of each landing page."""
    each = catalog.select(F.coalesce("source_priority", F.lit(LAST)).alias("source_priority"), "work_id", "source", F.explode("urls").alias("key")).where("key IS NOT NULL")
    return each.groupBy("key").agg(F.min(F.struct("source_priority", "work_id", "source")).alias("b")).select("key", "b.*")


@dataclass(frozen=True)
class KeyIndex:
    """Where the tables are, and their buckets."""

    path: str
    buckets: int

    def keys(self, spark: SparkSession, kind: str) -> DataFrame:
        return read_bucketed(spark, f"{self.path}/{kind}", _DDL[kind], ["key"], self.buckets)

    def drop(self, spark: SparkSession) -> None:
        for kind in _DDL:
            forget_bucketed(spark, f"{self.path}/{kind}", ["key"], self.buckets)
        delete(spark, self.path)


def build_keys(catalog: DataFrame, path: str | None = None) -> KeyIndex:
    spark = catalog.sparkSession
    index = KeyIndex(path or shared_path(spark, "keys"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for kind in _DDL:
        write_bucketed(pages_of(catalog) if kind == "url" else keys_of(catalog, kind), f"{index.path}/{kind}", ["key"], index.buckets)
    spark.createDataFrame([(json.dumps(asdict(index)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/index")
    return index


def open_keys(spark: SparkSession, path: str) -> KeyIndex:
    """Tables that an earlier run has written."""
    return KeyIndex(**json.loads(spark.read.text(f"{path}/index").first()[0]) | {"path": path})
