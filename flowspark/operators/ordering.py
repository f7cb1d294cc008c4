"""Global order without a single-task window.

A frame is range-partitioned on the order key, sorted, and written once. Each
written slice knows its number and each row its place in the slice; only the
totals per slice (at most one row per shuffle partition) are looked at
globally, so row numbers and running sums stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.functions.scalars import quoted
from flowspark.staging import staged

SLICE, PLACE = "__slice", "__place"
_PLACE_BITS = 33  # monotonically_increasing_id keeps the row place in the low 33 bits


def sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partitioned, sorted, written copy with slice number and place."""
    row = F.monotonically_increasing_id()
    out = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__row", row)
        .select(
            *[quoted(c) for c in df.columns],
            F.shiftright("__row", _PLACE_BITS).alias(SLICE),
            F.col("__row").bitwiseAND((1 << _PLACE_BITS) - 1).alias(PLACE),
        )
    )
    return staged(out, "slices")


def _before(totals: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sum of each column over all earlier slices (of the same key)."""
    w = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        SLICE, *keys, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"__before_{n}") for n in names]
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Dense number of every row in the given total order."""
    slices = sorted_slices(df, order)
    counts = slices.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    # one row per slice, at most spark.sql.shuffle.partitions of them
    offsets = F.broadcast(_before(counts, ["n"]))
    return slices.join(offsets, SLICE).select(
        *[quoted(c) for c in df.columns],
        (F.col("__before_n") + F.col(PLACE) + F.lit(start)).cast("long").alias(name),
    )


def with_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it is when it has the id column ``name``, else written once
    with the number of each row in stored order."""
    if name in df.columns:
        return df
    place = F.monotonically_increasing_id()
    return staged(row_numbers(df.withColumn("__stored_order", place), [F.col("__stored_order")], name).drop("__stored_order"), "ids")


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums (new name -> column) along ``order`` per key.

    ``order`` must be a total order within a key. Keys may be few and large:
    a key spreads over as many slices as its rows need.
    """
    slices = sorted_slices(df, [*[F.col(k) for k in keys], *order])
    columns = list(dict.fromkeys(sums.values()))
    totals = slices.groupBy(SLICE, *keys).agg(*[F.sum(c).alias(c) for c in columns])
    before = _before(totals, columns, keys)
    local = W.partitionBy(SLICE, *keys).orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    out = slices
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(local))
    # rows of `before`: slices + keys that share one, small next to the data
    out = out.join(before if keys else F.broadcast(before), [SLICE, *keys])
    return out.select(
        *[quoted(c) for c in df.columns],
        *[(F.col(n) + F.col(f"__before_{c}")).alias(n) for n, c in sums.items()],
    )


def with_next(df: DataFrame, order: Sequence[Column], names: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Add the values of the following row in a total order."""
    slices = sorted_slices(df, order)
    inside = W.partitionBy(SLICE).orderBy(PLACE)
    after = W.orderBy(SLICE)
    heads = slices.where(F.col(PLACE) == 0).select(SLICE, *names)  # one row per slice
    tails = heads.select(
        SLICE, *[F.lead(n).over(after).alias(f"__head_{n}") for n in names]
    )
    out = slices
    for n in names:
        out = out.withColumn(prefix + n, F.lead(n).over(inside))
    out = out.join(F.broadcast(tails), SLICE)
    return out.select(
        *[quoted(c) for c in df.columns],
        *[F.coalesce(F.col(prefix + n), F.col(f"__head_{n}")).alias(prefix + n) for n in names],
    )
