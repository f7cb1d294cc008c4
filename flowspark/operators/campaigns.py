"""Attack campaigns: what each attacker did to whom, and when.

The result is three flat tables keyed by source and attack type. One source
may reach any number of targets, so targets stay rows and are never gathered
into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowspark.config import SUSPICIOUS_LEVELS, FlowColumns
from flowspark.functions.scalars import quoted
from flowspark.operators.graph import suspicious


def attackers(ranking: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    return ranking.where(F.col("role") == "attacker").select(F.col(quoted(cols.src_ip)).alias("ip"), "threat_score", "role")


def flow_cells(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Suspicious flows counted per (source, label, target): small before any join."""
    label = F.col(quoted(cols.label)) if cols.label in df.columns else F.lit("unknown")
    aggs = [F.count(F.lit(1)).alias("flows"),
            *[F.count_if(F.col("alert_level") == n).alias(n.lower()) for n in SUSPICIOUS_LEVELS]]
    if cols.timestamp in df.columns and cols.label in df.columns:
        aggs += [F.min(quoted(cols.timestamp)).alias("start_time"), F.max(quoted(cols.timestamp)).alias("end_time")]
    else:
        aggs += [F.lit(None).cast("timestamp_ntz").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time")]
    return suspicious(df).groupBy(
        F.col(quoted(cols.src_ip)).alias("ip"), label.alias("attack_type"), F.col(quoted(cols.dst_ip)).alias("target")).agg(*aggs)


def _attack_cells(df: DataFrame, ranking: DataFrame, cols: FlowColumns) -> DataFrame:
    cells = flow_cells(df, cols).join(attackers(ranking, cols).select("ip"), "ip", "left_semi")
    named = F.upper(F.trim("attack_type"))
    return cells.where(F.col("attack_type").isNotNull() & (named != "BENIGN"))


def campaigns(df: DataFrame, ranking: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """One row per (attacker, attack type): flows, period and target count."""
    return _attack_cells(df, ranking, cols).groupBy("ip", "attack_type").agg(
        F.sum("flows").alias("total_flows"), F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"), F.count("target").alias("n_targets"))


def campaign_targets(df: DataFrame, ranking: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """One row per (attacker, attack type, target) with level counts and path text."""
    return _attack_cells(df, ranking, cols).where("target is not null").select(
        "ip", "attack_type", "target", "flows", *[n.lower() for n in SUSPICIOUS_LEVELS],
        F.concat("ip", F.lit(" -> "), "target").alias("path"))


def campaign_sources(df: DataFrame, ranking: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Attackers with their score and all their suspicious flows."""
    flows = suspicious(df).groupBy(F.col(quoted(cols.src_ip)).alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    return attackers(ranking, cols).join(flows, "ip", "left").select(
        "ip", "threat_score", "role", F.coalesce("n", F.lit(0)).alias("total_attack_flows"))
