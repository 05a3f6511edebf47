"""Small helpers that the operators share: table access, shared scratch, typed empties."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Partitions of one exchange at most; beyond it a task works through several ranges, shards or
#: buckets in turn, so that the driver's share stays bounded at any size of the input.
MOST_TASKS = 50_000


def tasks_for(size: int, each: int) -> int:
    """How many partitions work of a size gets, ``each`` as one unit."""
    return max(1, min(-(-size // each), MOST_TASKS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    The setting is read from the session; only where it is unset (local tests) is a
    folder below the warehouse used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/forge-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage durably.

    Lost executors cannot lose the result, and nothing upstream runs twice. The files
    may be deleted once the final result is written, as checkpoint files may.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            context = t.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
