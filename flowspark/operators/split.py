"""Exact stratified splits without moving rows.

Each class gets its quota; a row's place in its class follows a hash of its
id, so a class is cut at exact hash values found by counting. The split is
then one projection, however large a class is.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, functions as F

from flowspark.config import FlowColumns, PrepareConfig
from flowspark.functions.scalars import quoted
from flowspark.operators.ordering import row_numbers
from flowspark.operators.quantiles import hash_cutoffs, within_cut
from flowspark.staging import local_table


def _shares(counts: dict, total_take: int) -> dict:
    """Largest-remainder shares of ``total_take`` over the classes."""
    total = sum(counts.values())
    exact = {c: total_take * n / total for c, n in counts.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    rest = total_take - sum(out.values())
    by_rest = sorted(counts, key=lambda c: (-(exact[c] - out[c]), str(c)))
    for c in by_rest[:rest]:
        out[c] += 1
    return out


def split_quotas(counts: dict, cfg: PrepareConfig = PrepareConfig()) -> dict:
    """Rows per class for (train, val, test); classes of one row all train."""
    single = {c for c, n in counts.items() if n < 2}
    if single:
        warnings.warn(f"classes with a single row go to train: {sorted(map(str, single))}")
    usable = {c: n for c, n in counts.items() if c not in single}
    if not usable:
        return {c: (n, 0, 0) for c, n in counts.items()}
    n = sum(usable.values())
    train = _shares(usable, math.floor(cfg.train_ratio * n))
    rest = {c: usable[c] - train[c] for c in usable}
    # the share is taken of the rest in double arithmetic: 0.15 / (1 - 0.7) < 0.5
    val = _shares(rest, math.floor(cfg.val_ratio / (1.0 - cfg.train_ratio) * sum(rest.values())))
    quotas = {c: (train[c], val[c], rest[c] - val[c]) for c in usable}
    quotas.update({c: (counts[c], 0, 0) for c in single})
    return quotas


def stratified_split(
    df: DataFrame, label: str, name: str, cfg: PrepareConfig = PrepareConfig()
) -> DataFrame:
    """Add the column ``name`` with train / val / test, class shares kept."""
    sid = cfg.columns.sample_id
    keyed = df.withColumn("__class", F.col(quoted(label)).cast("string"))
    counts = {r["__class"]: r["n"] for r in keyed.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no class in {label!r}: drop or name them before splitting")
    quotas = split_quotas(counts, cfg)
    takes = {c: [t, t + v] for c, (t, v, _) in quotas.items()}
    cuts = hash_cutoffs(keyed, sid, "__class", takes, cfg.seed)
    rows = []
    for c, (t, v, _) in quotas.items():
        rows.append((c, *cuts[c, t], *cuts[c, t + v]))
    # one row per class; its exact size lets Spark decide on the broadcast
    limits = local_table(df.sparkSession, rows, "__class string, __h1 long, __i1 long, __h2 long, __i2 long")
    split = (
        F.when(within_cut(sid, cfg.seed, F.col("__h1"), F.col("__i1")), "train")
        .when(within_cut(sid, cfg.seed, F.col("__h2"), F.col("__i2")), "val")
        .otherwise("test")
    )
    return keyed.join(limits, "__class").select(*[quoted(c) for c in df.columns], split.alias(name))


def split_flows(df: DataFrame, cfg: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Binary and multi-class split as two columns of one table."""
    cols = cfg.columns
    out = stratified_split(df, cols.binary_label, "split_binary", cfg)
    return stratified_split(out, cols.label, "split_multiclass", cfg)


def attach_split(
    df: DataFrame, splits: DataFrame, name: str, cols: FlowColumns = FlowColumns()
) -> DataFrame:
    """Left-join a split name by sample id; ids without one are ``unknown``."""
    named = splits.select(quoted(cols.sample_id), F.col(name))
    return df.join(named, cols.sample_id, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit("unknown"))
    )


def union_splits(frames: dict[str, DataFrame], name: str, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Stack (id, split name) of separately stored splits."""
    out = None
    for split, frame in frames.items():
        part = frame.select(quoted(cols.sample_id), F.lit(split).alias(name))
        out = part if out is None else out.unionByName(part)
    return out


def label_counts(df: DataFrame, by: str, label: str) -> DataFrame:
    return df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Class counts and the weight of the positive class."""
    y = F.col(quoted(cols.binary_label))
    out = df.agg(F.count_if(y == 0).alias("n_neg"), F.count_if(y == 1).alias("n_pos"))
    weight = F.when(F.col("n_pos") > 0, F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)))
    return out.withColumn("pos_weight", weight.otherwise(F.lit(1.0)).cast("double"))


def label_mapping(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Distinct labels numbered from 0 in sorted order."""
    labels = df.select(F.col(quoted(cols.label)).cast("string").alias("label")).distinct()
    return row_numbers(labels, [F.col("label").asc()], "code").select(F.col("code").cast("int").alias("code"), "label")
