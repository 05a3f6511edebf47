"""Counts over reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISSUES = ("NOT_FOUND", "DEAD_URL", "METADATA_MISMATCH", "CONTENT_DRIFT")


def summary(reports: DataFrame, *by: str) -> DataFrame:
    """A1: totals of a batch, or per group."""
    v = F.col("verdict")
    return reports.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(v == "VERIFIED").alias("verified"), F.count_if(v.isin(*ISSUES)).alias("issues"), F.count_if(v == "UNRESOLVABLE").alias("skipped")
    )


def gate(reports: DataFrame, *by: str) -> DataFrame:
    """A2: whether anything is not found or dead."""
    return reports.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("verdict").isin("NOT_FOUND", "DEAD_URL")), F.lit(False)).alias("failed"))


def unparsed(refs: DataFrame) -> DataFrame:
    """A3: references without a title and an identifier."""
    none = F.col("title").isNull() & F.col("doi").isNull() & F.col("arxiv_id").isNull()
    return refs.agg(F.count_if(none).alias("unparsed"))


def rate_by_year(reports: DataFrame) -> DataFrame:
    """A4: share of verified references by year."""
    return reports.groupBy("year").agg(F.count("*").alias("total"), F.avg((F.col("verdict") == "VERIFIED").cast("double")).alias("verified_share"))
