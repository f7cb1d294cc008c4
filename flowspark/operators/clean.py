"""Cleaning, imputation and scaling of flow features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.config import FlowColumns, PrepareConfig
from flowspark.functions.scalars import binary_label, finite, has_label, quoted, to_number
from flowspark.operators.quantiles import exact_quantiles


def keep_labelled(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Drop rows whose label is missing or blank."""
    return df.where(has_label(cols.label))


def unlabelled_count(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~has_label(cols.label)).alias("n_dropped"),
    )


def add_binary_label(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    if cols.label not in df.columns:
        raise KeyError(f"no label column {cols.label!r}")
    return df.withColumn(cols.binary_label, binary_label(cols.label))


def candidate_columns(df: DataFrame, cols: FlowColumns = FlowColumns()) -> list[str]:
    """All columns that are not protected, in table order."""
    fixed = set(cols.protected())
    return [c for c in df.columns if c not in fixed]


def numeric_features(df: DataFrame, cols: FlowColumns = FlowColumns()) -> list[str]:
    names = set(candidate_columns(df, cols))
    found = [f.name for f in df.schema if f.name in names and isinstance(f.dataType, T.NumericType)]
    if not found:
        raise ValueError("no numeric feature column")
    return found


def coerce_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Text cells to doubles, everything non-finite to NULL."""
    kinds = {f.name: f.dataType for f in df.schema}
    casts = {}
    for c in features:
        text = isinstance(kinds[c], T.StringType)
        casts[c] = finite(to_number(c) if text else F.col(quoted(c)).cast("double"))
    return df.withColumns(casts)


def drop_incomplete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in features:
        keep = keep & F.col(quoted(c)).isNotNull()
    return df.where(keep)


def constant_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature with the flag ``is_constant`` (NULL counts as a value)."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.min(quoted(c)).alias("lo"), F.max(quoted(c)).alias("hi"), F.count(quoted(c)).alias("k")).alias(f"s{i}")
          for i, c in enumerate(features)],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s"))
                      for i, c in enumerate(features)])
    flat = stats.select("n", F.explode(pairs).alias("e")).select("n", "e.feature", "e.s.*")
    same = (F.col("k") == 0) | ((F.col("k") == F.col("n")) & (F.col("lo") == F.col("hi")))
    return flat.select("feature", same.cast("int").alias("is_constant"))


def clean_features(df: DataFrame, cfg: PrepareConfig = PrepareConfig()) -> tuple[DataFrame, list[str]]:
    """Coerce, drop incomplete rows, drop constant features; returns features too."""
    features = candidate_columns(df, cfg.columns)
    df = coerce_numeric(df, features)
    if cfg.on_all_null == "drop_column":
        filled = df.agg(*[F.count(quoted(c)).alias(str(i)) for i, c in enumerate(features)]).first()
        empty = [c for i, c in enumerate(features) if filled[i] == 0]
        df, features = df.drop(*empty), [c for c in features if c not in empty]
    df = drop_incomplete(df, features)
    constant = [r.feature for r in constant_columns(df, features).where("is_constant = 1").collect()]
    df = df.drop(*constant)
    kept = [c for c in features if c not in set(constant)]
    if not kept:
        raise ValueError("no feature is left after cleaning")
    return df, kept


def align_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise KeyError(f"missing feature columns, e.g. {missing[:5]}")
    return df.select(*[quoted(c) for c in features])


def nonfinite_audit(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """Counts of missing and infinite cells over all features."""
    missing, infinite = F.lit(0), F.lit(0)
    for c in features:
        v = F.col(quoted(c)).cast("double")
        missing = missing + F.when(v.isNull() | F.isnan(v), 1).otherwise(0)
        infinite = infinite + F.when(F.abs(v) == float("inf"), 1).otherwise(0)
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.sum(missing).cast("long").alias("n_missing"),
                       F.sum(infinite).cast("long").alias("n_infinite"))


def column_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    return {c: v for (c, _), v in exact_quantiles(df, features, [0.5]).items()}


def impute(df: DataFrame, medians: Mapping[str, float | None], default: float | None = None) -> DataFrame:
    """Fill non-finite cells with medians fitted anywhere; ``default`` where none exists."""
    fills = {}
    for c, m in medians.items():
        m = default if m is None else m
        value = finite(F.col(quoted(c)).cast("double"))
        fills[c] = value if m is None else F.coalesce(value, F.lit(float(m)))
    return df.withColumns(fills)


def impute_own(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill with the frame's own medians, 0 where a column has no finite value."""
    return impute(df, column_medians(df, features), default=0.0)


def scale_stats(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature, zero deviations as 1."""
    row = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(quoted(c)).alias(f"d{i}") for i, c in enumerate(features)],
    ).first()
    n = len(features)
    return {c: (row[i], row[n + i] if row[n + i] else 1.0) for i, c in enumerate(features)}


def standardise(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(quoted(c)) - F.lit(m)) / F.lit(d) for c, (m, d) in stats.items()}
    )
