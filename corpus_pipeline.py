"""From raw documents to piece ids: toxic documents go, boilerplate lines go,
one document of each group of near copies stays, sources are mixed to target
weights, and the texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again. All stages but the last
return the columns of ``documents`` in their order; a further column of any
name passes through. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark.llm.lines import line_dedup
from flowspark.llm.mixing import mixed_documents
from flowspark.llm.pieces import encode
from flowspark.llm.simhash import drop_near_copies
from flowspark.llm.toxicity import drop_toxic
from flowspark.staging import staged


def _few_rows_a_batch(spark: SparkSession) -> None:
    """Texts are long rows: fewer of them at a time go to the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity cut. Null texts score like empty
    ones, long texts as a whole, repeated rows each for itself."""
    _few_rows_a_batch(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that are boilerplate of its source, where
    copies and near copies of a page count once: they only go in the next
    stage; ``n_chars`` follows the text. Null texts stay null, null sources are
    one source, repeated rows all stay."""
    return line_dedup(docs, count_copies=False).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; one of
    equal rows, all rows without an id. Null and empty texts are one group."""
    _few_rows_a_batch(spark)
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes; null and empty
    texts are never taken, repeated rows each for itself."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text and whether they give the text back; null texts
    have none, long texts are encoded whole, repeated rows alike."""
    _few_rows_a_batch(spark)
    out = encode(docs, restored="restored")
    return out.select("doc_id", "lang", "source", F.greatest(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "restored")


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash", near_copies), ("mixing", mix), ("sentencepiece", pieces)]

#: The classifier's scores have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
