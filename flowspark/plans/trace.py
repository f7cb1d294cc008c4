"""Tracing alerts back to their sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowspark.config import TraceConfig
from flowspark.operators import campaigns as ca, display, evidence, graph
from flowspark.operators.summary import ensemble_summary, flow_detail
from flowspark.operators.threat import threat_ranking
from flowspark.sinks import save_trace
from flowspark.staging import staged


@dataclass
class Trace:
    ranking: DataFrame
    graph: DataFrame
    sources: DataFrame
    campaigns: DataFrame
    targets: DataFrame
    evidence: DataFrame
    stats: DataFrame
    nodes: DataFrame
    edges: DataFrame
    timeline: DataFrame | None


def trace_attacks(trace: DataFrame, preds: DataFrame, summary: DataFrame | None = None, cfg: TraceConfig = TraceConfig()) -> Trace:
    """Ranking, graph, campaigns, evidence and drawing tables from one detail
    table that is written once and read by all of them."""
    cols = cfg.columns
    detail = staged(flow_detail(trace, preds, cols), "detail")
    summary = ensemble_summary(detail, cols) if summary is None else summary
    ranks = graph.pagerank(graph.weighted_edges(detail, cols), cfg)
    ranking = staged(threat_ranking(summary, ranks, cfg), "ranking")
    edges = staged(graph.attack_graph(detail, cols), "graph")
    return Trace(
        ranking=ranking, graph=edges,
        sources=ca.campaign_sources(detail, ranking, cols), campaigns=ca.campaigns(detail, ranking, cols),
        targets=ca.campaign_targets(detail, ranking, cols), evidence=evidence.evidence_chains(detail, ranking, cfg),
        stats=graph.graph_stats(edges, ranking), nodes=display.display_nodes(detail, ranking, cfg),
        edges=display.display_edges(detail, cfg),
        timeline=display.timeline(detail, ranking, cfg) if cols.timestamp in detail.columns else None)


def save(result: Trace, folder: str, cfg: TraceConfig = TraceConfig()) -> None:
    save_trace(result.ranking, result.sources, result.campaigns, result.targets, result.evidence, result.stats,
               folder, cfg.columns.src_ip)
