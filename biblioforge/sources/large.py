"""Files larger than a task, and dumps: read record by record.

Bibliography files are cut at what stands between their records by Spark's own text reader, which
splits a file of any size by bytes. XML dumps are cut at the end of their records, JSON dumps at lines. Both
keep what cannot be read in a column of its own instead of failing or losing it in silence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, keep
from . import catalog as G
from . import formats

#: What stands between records, and what of it belongs to the one that follows.
SEPARATORS = {"ris": ("\nER  -", ""), "nbib": ("\nPMID-", "PMID-"), "bibtex": ("\n@", "@"), "doi_list": ("\n", "")}
#: Files up to this size are read whole.
WHOLE_BYTES = 32 << 20
#: Records of a chunk, inside which a record that was cut by mistake looks for its beginning.
CHUNK = 1 << 16
BROKEN = "_corrupt_record"


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with doc_id and block as read, kept, and ``seq``, their number in the file. Every split
    numbers its own rows; a sum over the splits before it, of which a file has few, does the rest."""
    kept = keep(rows.withColumn("at", F.monotonically_increasing_id()))
    blocks = kept.groupBy("doc_id", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = keep(kept.join(blocks.withColumn("before", before).drop("n"), ["doc_id", "block"]).withColumn("seq", F.col("before") + F.col("at") - F.col("first")).drop("before", "at", "first", "block"))
    discard(kept)
    return out


def read_split(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """(doc_id, seq, text): the records of files of a format, numbered inside each file."""
    between, begins = SEPARATORS[kind]
    lines = spark.read.option("lineSep", between).text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("text"))
    return _numbered(lines).withColumn("text", F.when(F.col("seq") > 0, F.concat(F.lit(begins), "text")).otherwise(F.col("text")))


def rejoined(records: DataFrame, begins: str) -> DataFrame:
    """Records that do not begin as one (a line of a field that looked like a separator) go back
    to the one before. Its number is carried from chunk to chunk, so no file is one task."""
    rows = records.withColumn("real", F.col("text").rlike(begins) | (F.col("seq") == 0))
    if rows.where("NOT real").isEmpty():
        return records
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    own = F.max(F.when(F.col("real"), F.col("seq")))
    carried = own.over(Window.partitionBy("doc_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.groupBy("doc_id", "chunk").agg(own.alias("last"))
    last = last.select("doc_id", "chunk", F.max("last").over(Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    owned = rows.withColumn("mine", carried).join(last, ["doc_id", "chunk"]).withColumn("owner", F.coalesce("mine", "earlier"))
    whole = owned.groupBy("doc_id", "owner").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s"))
    return whole.select("doc_id", F.col("owner").alias("seq"), F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"))


def parse_split(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """References of files of a format, of any size; ``pos`` is the record's number."""
    records = read_split(spark, path, kind)
    if kind == "bibtex":
        whole = rejoined(records, r"^@\w+\s*[{(]")
        # entries that are indented are not cut by the reader
        parts = whole.select("doc_id", "seq", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), formats.BIBTEX_ENTRY)).alias("part", "raw")).where("raw rlike '@'")
        return formats._bibtex(parts.select("doc_id", F.struct("seq", "part").alias("pos"), "raw"))
    return formats.PARSERS[kind](records.select("doc_id", "text", F.col("seq").alias("base")))


def parse_path(spark: SparkSession, path: str, hint: str | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """S1 to S8 for a folder of files of any size and format. Of large files those whose format has
    records are split; JSON lists, TEI and plain text are read whole at any size."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r.path for r in listed.where(F.col("length") > whole_bytes).collect()]
    kinds = {p: hint or next((f for s, f in formats.SUFFIXES.items() if p.lower().endswith(s)), None) for p in large}
    if unknown := [p for p, k in kinds.items() if k is None]:
        nth = F.row_number().over(Window.partitionBy("path").orderBy("at"))
        lines = spark.read.text(unknown).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value").where("block = 0 AND value RLIKE '\\\\S'")
        heads = lines.withColumn("at", F.monotonically_increasing_id()).withColumn("n", nth).where("n <= 10").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("head"))
        found = {r.path.split("/")[-1]: r.kind for r in heads.select("path", formats.sniff(F.col("head")).alias("kind")).collect()}
        kinds |= {p: found.get(p.split("/")[-1], "plaintext") for p in unknown}
    apart = [p for p, k in kinds.items() if k in SEPARATORS]
    small = formats.read_files(spark, path, hint, None if not apart else F.col("length") <= whole_bytes)
    if rest := [p for p in large if p not in apart]:
        small = small.unionByName(formats.read_files(spark, rest, hint)) if apart else small
    parts = [formats.parse_files(small)] + [parse_split(spark, [p for p in apart if kinds[p] == k], k) for k in sorted({kinds[p] for p in apart})]
    return reduce(DataFrame.unionByName, parts)


def _with_broken(ddl: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField(BROKEN, T.StringType())])


def read_xml(spark: SparkSession, path: str, row_tag: str, ddl: str) -> DataFrame:
    """Records of XML dumps; ``_corrupt_record`` holds the text of broken ones. The text reader cuts
    at the end tag, so a file is many splits and a broken record costs itself only, where
    Spark's XML reader takes a file as one stream and gives up the rest of it. With columns
    doc_id and block of the file and split."""
    end = f"</{row_tag}>"
    lines = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("text"))
    found = lines.withColumn("text", F.concat(F.regexp_extract("text", rf"(?s)<{row_tag}(?:[\s>].*|$)", 0), F.lit(end))).where(F.length("text") > len(end))
    parsed = F.from_xml("text", _with_broken(ddl), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = found.withColumn("p", parsed)
    names = T.StructType.fromDDL(ddl).names
    return rows.select("doc_id", "block", *(F.col("p")[n].alias(n) for n in names), F.coalesce(F.col("p")[BROKEN], F.when(F.col("p").isNull(), F.col("text"))).alias(BROKEN))


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of JSON-lines dumps, folders by ``date`` included; broken lines as above."""
    return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).schema(_with_broken(ddl)).json(path)


def newest(rows: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Of the records of an id that snapshots repeat, that of the last date; of one date the largest."""
    kept = [c for c in rows.columns if c not in (BROKEN, date)]
    good = rows.where(F.col(BROKEN).isNull() & (F.length(F.col(key)) > 0))
    return good.groupBy(F.col(key).alias("_id")).agg(F.max(F.struct(F.col(date), F.struct(*kept).alias("r"))).alias("m")).select("m.r.*")


def broken(rows: DataFrame, *by: str) -> DataFrame:
    """How many records were read and how many are broken, by columns such as the date."""
    other = next(c for c in rows.columns if c != BROKEN)
    # Spark refuses to read the broken ones alone from JSON files, so few columns are kept first
    few = keep(rows.select(*by, F.col(other).isNotNull().alias("_other"), F.col(BROKEN).isNotNull().alias("_bad")))
    out = keep(few.groupBy(*by).agg(F.count("*").alias("records"), F.count_if("_bad").alias("broken")))
    discard(few)
    return out


def catalog_of_dump(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """A source's dump to catalog rows, and the records that were read with ``_corrupt_record``. JSON
    dumps may have folders by date, of which the newest record of an id counts."""
    dump = G.DUMPS[source]
    if dump.row_tag:
        rows = read_xml(spark, path, dump.row_tag, dump.ddl)
        return dump.shape(rows.where(F.col(BROKEN).isNull()).drop(BROKEN, "doc_id", "block")), rows
    rows = read_json(spark, path, dump.ddl)
    last = newest(rows, dump.key) if "date" in rows.columns else rows.where(F.col(BROKEN).isNull()).drop(BROKEN)
    return dump.shape(last), rows


def refs_of_tei(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8 for TEI files of any size: references, and the records with ``_corrupt_record``."""
    rows = _numbered(read_xml(spark, path, "biblStruct", formats.TEI))
    work = F.struct(*T.StructType.fromDDL(formats.TEI).names)
    return formats.tei_refs(rows.where(F.col(BROKEN).isNull()).select("doc_id", F.col("seq").alias("pos"), work.alias("e"), F.to_json(work).alias("raw"))), rows
