"""Tables behind the attack graph drawing and the timeline heat map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowspark.config import SUSPICIOUS_LEVELS, TraceConfig
from flowspark.functions.scalars import hour_bin, quoted
from flowspark.operators.graph import _with_ends, suspicious
from flowspark.staging import staged

# Colours of roles and edges.
ROLE_COLOURS = {"attacker": "#e74c3c", "suspect": "#f39c12", "victim": "#3498db", "normal": "#95a5a6"}
EDGE_COLOURS = {"critical": "#e74c3c", "mixed": "#f39c12", "other": "#7f8c8d"}


def edge_totals(df: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Flows per edge and level with the mean risk."""
    return _with_ends(suspicious(df), cfg.columns).groupBy("src", "dst").agg(
        F.count(quoted(cfg.columns.sample_id)).alias("flow_count"),
        *[F.count_if(F.col("alert_level") == n).alias(n.lower()) for n in SUSPICIOUS_LEVELS],
        F.avg("risk_score").alias("avg_risk"))


def shown_edges(df: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """The busiest edges, as many as the drawing takes."""
    return edge_totals(df, cfg).orderBy(F.col("flow_count").desc(), "src", "dst").limit(cfg.max_edges)


def display_edges(df: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Width, colour and hover text per shown edge."""
    n = F.greatest(F.col("flow_count"), F.lit(1)).cast("double")
    critical = F.col("critical") / n
    colour = F.when(critical > 0.5, EDGE_COLOURS["critical"]).when(critical > 0.1, EDGE_COLOURS["mixed"]).otherwise(EDGE_COLOURS["other"])
    title = F.format_string(
        "%s → %s<br>Flows: %d<br>C=%d H=%d M=%d<br>Avg Risk: %.4f",
        "src", "dst", "flow_count", "critical", "high", "medium", "avg_risk")
    return shown_edges(df, cfg).select(
        "src", "dst", "flow_count", F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.log2(n) * 1.5)).alias("width"),
        colour.alias("color"), title.alias("title"))


def display_nodes(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Role, size, colour and hover text per endpoint of the shown edges."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("flow_count").alias("out_flows"), F.lit(0).cast("long").alias("in_flows")),
        F.struct(F.col("dst").alias("node"), F.lit(0).cast("long").alias("out_flows"), F.col("flow_count").alias("in_flows")))
    nodes = shown_edges(df, cfg).select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(
        F.sum("out_flows").alias("out_flows"), F.sum("in_flows").alias("in_flows"))  # at most two per shown edge
    known = ranking.select(F.col(quoted(cfg.columns.src_ip)).alias("node"), F.col("role"), F.col("threat_score"))
    # node rows are bounded by the edge limit, so the ranking is never the copied side
    nodes = known.join(F.broadcast(nodes), "node", "right").withColumns(
        {"role": F.coalesce("role", F.lit("normal")), "threat_score": F.coalesce("threat_score", F.lit(0.0))})
    role = F.when((F.col("role") == "normal") & (F.col("in_flows") > F.col("out_flows")), "victim").otherwise(F.col("role"))
    colour = F.lit(ROLE_COLOURS["normal"])
    for name in ("attacker", "suspect", "victim"):
        colour = F.when(F.col("display_role") == name, ROLE_COLOURS[name]).otherwise(colour)
    total = F.greatest(F.col("out_flows") + F.col("in_flows"), F.lit(1)).cast("double")
    title = F.format_string(
        "<b>%s</b><br>Role: %s<br>Threat Score: %.4f<br>Outgoing Attack Flows: %d<br>Incoming Attack Flows: %d",
        "node", "display_role", "threat_score", "out_flows", "in_flows")
    return nodes.withColumn("display_role", role).select(
        "node", "display_role", "threat_score", "out_flows", "in_flows", colour.alias("color"),
        F.greatest(F.lit(10.0), F.least(F.lit(60.0), F.lit(10.0) + F.log2(total) * 5)).alias("size"), title.alias("title"))


def timeline(df: DataFrame, ranking: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Flows per (source, hour) of the top watched sources, absent hours as 0.

    Sources become columns (as many as the chart shows), which fills the gaps
    without pairing sources and hours.
    """
    cols = cfg.columns
    top = ranking.where(F.col("role").isin("attacker", "suspect")).orderBy("rank").limit(cfg.timeline_sources)
    names = {r[cols.src_ip]: r["rank"] for r in top.select(quoted(cols.src_ip), "rank").collect()}  # at most timeline_sources
    spark = df.sparkSession
    schema = "source_ip string, rank long, hour_bin timestamp_ntz, flows long, log_flows double"
    if not names:
        return spark.createDataFrame([], schema)
    ip, ts = F.col(quoted(cols.src_ip)), F.col(quoted(cols.timestamp))
    rows = suspicious(df).where(ip.isin(*names) & ts.isNotNull())
    counts = rows.groupBy(hour_bin(ts).cast("timestamp_ntz").alias("hour_bin"), ip.alias("source_ip")).agg(F.count(F.lit(1)).alias("flows"))
    counts = staged(counts, "timeline")  # a row per shown source and hour, read twice below
    seen = sorted((r.source_ip for r in counts.select("source_ip").distinct().collect()), key=names.get)
    wide = counts.groupBy("hour_bin").agg(
        *[F.coalesce(F.sum(F.when(F.col("source_ip") == s, F.col("flows"))), F.lit(0)).alias(f"c{i}") for i, s in enumerate(seen)])
    cells = F.array(*[F.struct(F.lit(s).alias("source_ip"), F.lit(names[s]).cast("long").alias("rank"), F.col(f"c{i}").alias("flows"))
                      for i, s in enumerate(seen)])
    return wide.select("hour_bin", F.explode(cells).alias("c")).select(
        "c.source_ip", "c.rank", "hour_bin", "c.flows", F.log1p(F.col("c.flows").cast("double")).alias("log_flows"))
