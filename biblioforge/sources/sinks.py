"""Reports as files and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checks import shown
from ..schemas import present


def in_order(rows: DataFrame) -> DataFrame:
    """Rows in input order, by document and place; sampled ranges, so every task writes its part."""
    return rows.orderBy("doc_id", "pos")


def write_reports(reports: DataFrame, path: str, form: str = "json") -> None:
    """Nested JSON or Parquet, in input order from file to file."""
    in_order(reports).write.format(form).save(path)


def markdown(reports: DataFrame) -> DataFrame:
    """(doc_id, pos, markdown), a text per reference; order the sink by (doc_id, pos)."""
    title = F.coalesce(present(F.col("title")), present(F.substring(F.coalesce("raw", F.lit("")), 1, 60)), F.lit("(unknown)"))
    check = lambda n: F.when(F.col(n).isNotNull(), F.format_string("- `%s`: %s (confidence=%.2f)", F.lit(n), F.col(f"{n}.status"), F.col(f"{n}.confidence")))
    lines: list[Column] = [
        F.concat(F.lit("## "), title),
        F.concat(F.lit("**Verdict:** "), shown(F.col("verdict"))),
        F.concat(F.lit("**DOI:** "), present(F.col("doi"))),
        F.when(F.size("notes") > 0, F.concat(F.lit("**Notes:**\n"), F.array_join(F.transform("notes", lambda n: F.concat(F.lit("- "), n)), "\n"))),
        *map(check, ("existence", "url_liveness", "relevance")),
    ]
    return reports.select("doc_id", "pos", F.concat_ws("\n", *lines).alias("markdown"))
