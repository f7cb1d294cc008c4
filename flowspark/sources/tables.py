"""Stored tables and small documents."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowspark.functions.scalars import quoted
from flowspark.operators.clean import align_features
from flowspark.staging import exists


def require(spark: SparkSession, path: str, task: str = "", strict: bool = True) -> bool:
    """True when the input exists; else an error, or a warning if not strict."""
    if exists(spark, path):
        return True
    message = f"{task}: missing input {path}" if task else f"missing input {path}"
    if strict:
        raise FileNotFoundError(message)
    warnings.warn(message)
    return False


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by default, CSV by suffix."""
    require(spark, path)
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str, column: str = "split_binary", label: str | None = None) -> DataFrame:
    """One split of the partitioned table; only its folders are read."""
    df = read_table(spark, path)
    if label is not None and label not in df.columns:
        raise KeyError(f"split {split} has no label column {label!r}")
    return df.where(F.col(column) == split)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """Only the given columns, optionally of as many rows, smallest values
    first; the whole table with a warning when one of the columns is absent."""
    df = read_table(spark, path)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        warnings.warn(f"columns {absent} are absent from {path}, reading all columns")
    else:
        df = align_features(df, columns)
    return df if rows is None else df.orderBy(*[F.col(quoted(c)) for c in df.columns]).limit(rows)


def read_feature_names(spark: SparkSession, path: str) -> list[str]:
    """Feature list, one name per line, in written order."""
    require(spark, path)
    names = [r.value for r in spark.read.text(path, wholetext=False).select(F.trim("value").alias("value")).where("value <> ''").collect()]
    if not names:
        raise ValueError(f"empty feature list: {path}")
    return names


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document as one row."""
    require(spark, path)
    return spark.read.json(path, multiLine=True)


def theta_rf(document: DataFrame) -> float:
    """Forest cut named in a metrics document, else one half."""
    for field in document.schema:
        if field.name == "config" and isinstance(field.dataType, T.StructType) and "theta_rf" in field.dataType.names:
            value = document.select(F.col("config.theta_rf").cast("double")).first()[0]
            return 0.5 if value is None else value
    return 0.5


def flat_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Numeric entries of a JSON object: plain numbers and {"value": number};
    a ``metrics`` object inside is taken instead of the whole."""
    require(spark, path)
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    inner = F.try_variant_get("doc", "$.metrics", "variant")
    is_object = F.schema_of_variant(inner).startswith("OBJECT")
    chosen = text.select(F.when(is_object, inner).otherwise(F.col("doc")).alias("doc"))
    chosen.createOrReplaceTempView("__flat_metrics")
    pairs = spark.sql("select key, value from __flat_metrics, lateral variant_explode(doc)")
    kind = F.schema_of_variant("value")
    plain = F.when(~kind.isin("BOOLEAN", "STRING", "VOID") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"),
                   F.try_variant_get("value", "$", "double"))
    wrapped = F.when(kind.startswith("OBJECT"), F.try_variant_get("value", "$.value", "double"))
    return pairs.select(F.col("key").alias("name"), F.coalesce(plain, wrapped).alias("value")).where("value is not null")


def read_latency(spark: SparkSession, path: str) -> DataFrame | None:
    """``latency_ms`` or else the first numeric column, without gaps."""
    df = read_table(spark, path)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    name = "latency_ms" if "latency_ms" in df.columns else (numeric[0] if numeric else None)
    return None if name is None else df.select(F.col(quoted(name)).cast("double").alias("latency")).dropna()


def load_trace_inputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Summary, predictions, trace rows of the test split and, if there, edges."""
    out = {n: read_table(spark, f"{folder}/{n}") for n in ("ip_summary", "predictions", "trace_metadata")}
    if "split_binary" in out["trace_metadata"].columns:
        out["trace_metadata"] = out["trace_metadata"].where("split_binary = 'test'")
    if exists(spark, f"{folder}/trace_edges"):
        out["trace_edges"] = read_table(spark, f"{folder}/trace_edges")
    return out
