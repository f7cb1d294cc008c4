"""Evidence per attacker and suspect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from flowspark.config import ALERT_NAMES, CONFIRMED_LEVELS, TraceConfig
from flowspark.functions.scalars import quoted
from flowspark.operators.graph import suspicious


def watched_sources(ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    return ranking.where(F.col("role").isin("attacker", "suspect")).select(F.col(quoted(cfg.columns.src_ip)).alias("source_ip"))


def _by_source(df: DataFrame, cfg: TraceConfig) -> DataFrame:
    return df.withColumn("source_ip", F.col(quoted(cfg.columns.src_ip)))


def evidence_levels(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Alert-level histogram over all flows of a watched source."""
    counts = _by_source(df, cfg).groupBy("source_ip", "alert_level").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(watched_sources(ranking, cfg), "source_ip", "left_semi")


def evidence_types(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Attack classes with counts, the benign class left out."""
    label = F.col(quoted(cfg.columns.label))
    counts = _by_source(suspicious(df), cfg).where(F.upper(F.trim(label)) != "BENIGN").groupBy(
        "source_ip", label.alias("type")).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(watched_sources(ranking, cfg), "source_ip", "left_semi")


def evidence_time(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """First and last sight, span of confirmed attacks, hour of day with most
    of them (the smallest hour on ties)."""
    ts = F.col(quoted(cfg.columns.timestamp))
    attack = F.when(F.col("alert_level").isin(*CONFIRMED_LEVELS), ts)
    spans = _by_source(df, cfg).groupBy("source_ip").agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.min(attack).alias("attack_start"), F.max(attack).alias("attack_end"),
        F.mode(F.hour(attack), True).alias("peak_attack_hour"))
    return spans.where("first_seen is not null").join(watched_sources(ranking, cfg), "source_ip", "left_semi")


def evidence_targets(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """The most attacked targets of every watched source. The rank filter is
    applied before the shuffle too, so a source with endless targets sends few."""
    counts = _by_source(suspicious(df), cfg).where(F.col(quoted(cfg.columns.dst_ip)).isNotNull()).groupBy(
        "source_ip", F.col(quoted(cfg.columns.dst_ip)).alias("target")).agg(F.count(F.lit(1)).alias("attack_flows"))
    w = W.partitionBy("source_ip").orderBy(F.col("attack_flows").desc(), "target")
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cfg.top_targets)
    return top.join(watched_sources(ranking, cfg), "source_ip", "left_semi")


def evidence_chains(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """One nested record per watched source. Lists hold attack classes and the
    top targets only, both short."""
    level = F.col("alert_level")
    levels = _by_source(df, cfg).groupBy("source_ip").agg(*[F.count_if(level == n).alias(n) for n in ALERT_NAMES.values()])
    names = list(ALERT_NAMES.values())
    as_map = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])), lambda _, n: n > 0)
    levels = levels.select("source_ip", as_map.alias("alert_distribution"))
    types = evidence_types(df, ranking, cfg).groupBy("source_ip").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "type", "count"))).alias("t"))
    types = types.select("source_ip", F.transform("t", lambda t: F.struct(t["type"].alias("type"), t["count"].alias("count"))).alias("attack_types"))
    targets = evidence_targets(df, ranking, cfg).groupBy("source_ip").agg(
        F.sort_array(F.collect_list(F.struct("place", "target", "attack_flows"))).alias("t"))
    targets = targets.select("source_ip", F.transform("t", lambda t: F.struct(t["target"].alias("ip"), t["attack_flows"].alias("attack_flows"))).alias("top_targets"))
    out = ranking.where(F.col("role").isin("attacker", "suspect")).withColumn("source_ip", F.col(quoted(cfg.columns.src_ip)))
    out = out.join(levels, "source_ip", "left").join(types, "source_ip", "left").join(targets, "source_ip", "left")
    time_cols = []
    if cfg.columns.timestamp in df.columns:
        spans = evidence_time(df, ranking, cfg)
        time_cols = [c for c in spans.columns if c != "source_ip"]
        out = out.join(spans, "source_ip", "left")
    time = F.struct(*time_cols) if time_cols else F.struct(F.lit(None).cast("string").alias("first_seen"))
    return out.select(
        "source_ip", "role", "threat_score", "total_flows", "attack_flows", "attack_ratio", "alert_distribution",
        "attack_types", time.alias("time_evidence"), "top_targets", F.col("avg_risk").alias("avg_risk_score"),
        "avg_rf_prob", F.col("avg_unsup").alias("avg_unsup_score"))
