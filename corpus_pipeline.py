"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns what goes on, with the columns of documents;
the last returns the pieces of the packed sequences. No SQL stands for the whole (learned
scores, fingerprints and suffix sorting), so tests hold it against a brute-force version.

Defined cases follow the operators': null texts have no words and go at the quality stage;
of near copies the smallest doc_id stays, of rows alike in that one; a text that is repeated
elsewhere whole stays as an empty text; n_chars follows the text; an empty table packs to
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm import near_copies, packing, quality, suffix_dedup, toxicity
from biblioforge.llm.common import materialize, table

#: Bytes of a passage that goes where another text repeats it: fifty words of prose have 200
#: at least. (The query of the operator alone takes 400, as its contract says.)
PASSAGE, PASSAGE_GRAM = 200, 88


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, PASSAGE, PASSAGE_GRAM).drop("__cut")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(materialize(packing.token_pieces(docs)))


STAGES = [
    ("toxicity", toxic_documents),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
