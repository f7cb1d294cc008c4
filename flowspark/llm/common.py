"""What the corpus operators share: words, scratch tables, column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowspark.functions.scalars import quoted
from flowspark.staging import drop_path, new_path, ship_package, staged

#: A word is a maximal run of characters that are neither blank nor 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col(quoted(name))


def n_words(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased. ``bytes.lower`` touches
    A-Z only and ``bytes.split`` cuts at blank and 0x09-0x0D only."""
    return text.encode().lower().split() if text else []


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in names])


def append_columns(docs: DataFrame, of: str, new: dict[str, T.DataType], make: Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple]]) -> DataFrame:
    """``docs`` with the columns ``new`` (replacing those of these names) that
    ``make`` computes from column ``of``: it gets a partition's batches and the
    place of ``of`` and gives (part of a batch, values of each new column).
    Columns travel under plain names, so any names will do."""
    docs = without(docs, *new)
    names, at = docs.columns, docs.columns.index(of)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *values in make(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, *values], names=[*part.schema.names, *added])

    added = [f"n{i}" for i in range(len(new))]
    schema = T.StructType([*plain.schema.fields, *[T.StructField(n, kind) for n, kind in zip(added, new.values(), strict=True)]])
    return plain.mapInArrow(run, schema).toDF(*names, *new)


#: Spark's own switch: what a query shuffled is removed when the query ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared checkpoint folder that can be dropped one
    by one as soon as what was made of them is itself written. What was
    shuffled to write one goes at once."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}
        ship_package(spark)

    def write(self, df: DataFrame, name: str, observe: dict | None = None):
        path, conf = new_path(self.spark, f"{self.tag}-{name}"), self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            out = staged(df, name, observe, path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        self.paths[id(out[0] if observe else out)] = (out[0] if observe else out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                drop_path(self.spark, path)
