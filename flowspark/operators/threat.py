"""Threat score, rank and role of every source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowspark.config import FlowColumns, TraceConfig
from flowspark.functions.scalars import quoted, source_role
from flowspark.operators.ordering import row_numbers
from flowspark.staging import staged


def attach_pagerank(summary: DataFrame, ranks: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Left-join the rank of a source, 0 where the graph does not hold it."""
    named = ranks.select(F.col("node").alias(cols.src_ip), "pagerank")
    return summary.join(named, cols.src_ip, "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))


def threat_scores(summary: DataFrame, ranks: DataFrame | None, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Severity, scaled PageRank, threat score and role; one row per source."""
    cols = cfg.columns
    df = attach_pagerank(summary, ranks, cols) if ranks is not None else summary.withColumn("pagerank", F.lit(0.0))
    df, seen = staged(df, "threat", {"top": F.max("pagerank")})
    top = seen["top"] or 0.0
    severity = (3 * F.col("critical") + 2 * F.col("high") + F.col("medium")) / F.greatest(F.col("total_flows") * 3, F.lit(1))
    return df.withColumns({
        "alert_severity_score": severity,
        "norm_pagerank": F.col("pagerank") / F.lit(top) if top > 0 else F.lit(0.0),
    }).withColumns({
        "threat_score": F.lit(cfg.w_attack_ratio) * F.col("attack_ratio") + F.lit(cfg.w_centrality) * F.col("norm_pagerank")
        + F.lit(cfg.w_risk) * F.col("avg_risk") + F.lit(cfg.w_severity) * F.col("alert_severity_score"),
        "role": source_role("attack_ratio", cfg),
    })


def rank_sources(scored: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Rank from 1 by falling threat score, names break ties."""
    order = [F.col("threat_score").desc(), F.col(quoted(cfg.columns.src_ip)).asc()]
    return row_numbers(scored, order, "rank", start=1)


def threat_ranking(summary: DataFrame, ranks: DataFrame | None, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    return rank_sources(threat_scores(summary, ranks, cfg), cfg)
