"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import col, crc_bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, max_rows: int, max_bytes: int) -> DataFrame:
    """(doc_id, y, text) of at most ``max_rows`` labelled ids outside the held
    out fold, in hash order of the id. Ids without a label, null labels, null
    texts and texts over ``max_bytes`` are not drawn; of conflicting labels of
    an id the larger counts. The id list is bounded by ``max_rows`` and sent to
    where the texts are, so no text moves."""
    known = (labels.where(col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), mod) != held_out))
             .groupBy(F.col("doc_id").alias("__id")).agg(F.max(col(label)).cast("int").alias("y")))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    same = F.col("doc_id") == F.col("__id")
    if texts.schema["doc_id"].dataType != chosen.schema["__id"].dataType:  # compared as text, like the folds
        same = F.col("doc_id").cast("string") == F.col("__id").cast("string")
    return texts.join(F.broadcast(chosen), same).select("doc_id", "y", "text")


def fitted_rows(sample: DataFrame, max_rows: int):
    """The sample on the driver in hash order: at most ``max_rows`` rows even
    when ids repeat in the documents."""
    return sample.orderBy(F.xxhash64("doc_id"), *sample.columns[:2]).limit(max_rows).toArrow()
