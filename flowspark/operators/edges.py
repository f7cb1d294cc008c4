"""Trace metadata and the source-to-destination edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.config import FlowColumns
from flowspark.functions.scalars import quoted, share, to_timestamp


def trace_metadata(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """The trace columns that exist, plus split names where present."""
    wanted = [*cols.trace(), "split_binary", "split_multiclass"]
    return df.select(*[quoted(c) for c in wanted if c in df.columns])


def node_columns(df: DataFrame, cols: FlowColumns = FlowColumns()):
    """(source, target, kinds, extra keys) by what the schema offers, or None."""
    has = set(df.columns)
    if {cols.src_ip, cols.dst_ip} <= has:
        extra = [c for c in (cols.src_port, cols.dst_port, cols.protocol) if c in has]
        return cols.src_ip, cols.dst_ip, ("ip", "ip"), extra
    if {cols.source_file, cols.flow_id} <= has:
        return cols.source_file, cols.flow_id, ("file", "flow"), []
    if {cols.source_file, cols.dst_port} <= has:
        return cols.source_file, cols.dst_port, ("file", "port"), []
    return None


def _node(c: str):
    return F.coalesce(F.col(quoted(c)).cast("string"), F.lit("nan"))


def edge_table(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame | None:
    """One row per edge: flows, attacks, first and last time, attack share.

    Counts and times come from one aggregation; map-side partial sums keep a
    dominating edge cheap. None when the table has no node columns.
    """
    nodes = node_columns(df, cols)
    if nodes is None:
        return None
    src, dst, (src_kind, dst_kind), extra = nodes
    keys = [_node(src).alias("src_node"), _node(dst).alias("dst_node"),
            F.lit(src_kind).alias("src_node_type"), F.lit(dst_kind).alias("dst_node_type"),
            *[F.col(quoted(c)) for c in extra]]
    labelled = cols.binary_label in df.columns
    attacks = F.sum(quoted(cols.binary_label)).cast("long") if labelled else F.lit(None).cast("long")
    aggs = [F.count(F.lit(1)).alias("flow_count"), attacks.alias("attack_flow_count")]
    if cols.timestamp in df.columns:
        ts = F.col(quoted(cols.timestamp))
        if isinstance(df.schema[cols.timestamp].dataType, T.StringType):
            ts = to_timestamp(ts)
        aggs += [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")]
    edges = df.groupBy(*keys).agg(*aggs)
    ratio = share("attack_flow_count", "flow_count") if labelled else F.lit(None).cast("double")
    return edges.withColumn("attack_flow_ratio", ratio)
