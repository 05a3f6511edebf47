"""Intermediate and stored tables that several steps or runs read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or below the
    warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes inside go when each write ends, and not only with the driver's next
    garbage collection."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: computed once, safe from lost
    executors, and a short plan for what follows. ``discard`` deletes it."""
    path = shared_path(df.sparkSession, "keep")
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            delete(t.sparkSession, path)


def write_bucketed(df: DataFrame, path: str, by: list[str], buckets: int) -> None:
    """Files of a table at a path, dealt into buckets by columns and sorted inside. Nothing stays
    in the session's catalog, so another session can read them with ``read_bucketed``."""
    name = f"writes_{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # its files are outside the warehouse and stay


def _name_of(path: str, by: list[str], buckets: int) -> str:
    return "bucketed_" + hashlib.sha256(f"{path} {by} {buckets}".encode()).hexdigest()[:32]


def read_bucketed(spark: SparkSession, path: str, ddl: str, by: list[str], buckets: int) -> DataFrame:
    """Such a table, whose joins and groups by those columns need no shuffle."""
    name = _name_of(path, by, buckets)
    if not spark.catalog.tableExists(name):
        keys = ", ".join(by)
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def forget_bucketed(spark: SparkSession, path: str, by: list[str], buckets: int) -> None:
    """The session's name for such a table goes; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name_of(path, by, buckets)}")
