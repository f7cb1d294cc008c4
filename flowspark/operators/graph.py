"""Attack graph, weighted PageRank and graph queries."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from flowspark.config import SUSPICIOUS_LEVELS, FlowColumns, TraceConfig
from flowspark.functions.scalars import quoted
from flowspark.staging import drop_path, local_table, new_path, staged


def suspicious(df: DataFrame) -> DataFrame:
    """Flows above the LOW level."""
    return df.where(F.col("alert_level").isin(*SUSPICIOUS_LEVELS))


def _with_ends(df: DataFrame, cols: FlowColumns) -> DataFrame:
    src, dst = F.col(quoted(cols.src_ip)), F.col(quoted(cols.dst_ip))
    return df.where(src.isNotNull() & dst.isNotNull()).withColumns({"src": src, "dst": dst})


def weighted_edges(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Summed risk per (source, target) of the suspicious flows."""
    return _with_ends(suspicious(df), cols).groupBy("src", "dst").agg(F.sum("risk_score").alias("weight"))


def attack_graph(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Edges with flow counts per level. The means are those of the edge's
    first level in name order, not of all its flows."""
    levels = _with_ends(suspicious(df), cols).groupBy("src", "dst", "alert_level").agg(
        F.count(quoted(cols.sample_id)).alias("n"), F.avg("risk_score").alias("risk"), F.avg("rf_prob").alias("rf"))
    return levels.groupBy("src", "dst").agg(
        F.sum("n").alias("flow_count"),
        F.min_by("risk", "alert_level").alias("avg_risk"), F.min_by("rf", "alert_level").alias("avg_rf"),
        *[F.sum(F.when(F.col("alert_level") == n, F.col("n")).otherwise(0)).alias(n.lower()) for n in SUSPICIOUS_LEVELS])


def alerts_map(edges: DataFrame) -> DataFrame:
    """Fold the level counts of an edge into a map without the absent levels."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in SUSPICIOUS_LEVELS]),
                              F.array(*[F.col(n.lower()) for n in SUSPICIOUS_LEVELS]))
    return edges.withColumn("alerts", F.map_filter(pairs, lambda _, n: n > 0)).drop(*[n.lower() for n in SUSPICIOUS_LEVELS])


def node_set(edges: DataFrame) -> DataFrame:
    """Distinct endpoints."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def graph_stats(edges: DataFrame, ranking: DataFrame) -> DataFrame:
    """Nodes and edges of the attack graph, sources per role."""
    sizes = F.array(
        F.struct(F.lit("total_nodes").alias("stat"), F.lit(node_set(edges).count()).alias("n")),
        F.struct(F.lit("total_edges").alias("stat"), F.lit(edges.count()).alias("n")))
    roles = ranking.agg(
        F.count(F.lit(1)).alias("total_ips"), *[F.count_if(F.col("role") == r).alias(f"{r}_ips") for r in ("attacker", "suspect", "normal")])
    counts = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("n")) for c in roles.columns])
    return roles.select(F.explode(F.concat(counts, sizes)).alias("s")).select("s.stat", F.col("s.n").cast("long").alias("n"))


_PRE_SALTS = 16  # parts of a source's edges before its degree is known


def pagerank(edges: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """PageRank over weighted edges (src, dst, weight) -> (node, pagerank).

    A round is r' = A r + c 1, where A follows the edges and the number c holds
    the damping and the mass of nodes without out-edges. c needs a global sum,
    A does not: so several rounds of A run in one job, once for the ranks and,
    the first time, for the constant vector. The numbers c, the true ranks and
    the change per round then follow from sums over the written columns. The
    ranks after every round, and the round that ends it, are those of the plain
    iteration.

    Edges stay partitioned by source over all rounds; sources with very many
    edges are salted, and only their ranks are repeated per salt.
    """
    edges = staged(edges.select("src", "dst", F.col("weight").cast("double")), "edges")
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("strength"), F.count(F.lit(1)).alias("degree"))
    salts = F.greatest(F.ceil(F.coalesce("degree", F.lit(0)) / F.lit(cfg.hot_degree)), F.lit(1)).cast("int")
    nodes, seen = staged(
        node_set(edges).join(out, F.col("node") == F.col("src"), "left").select(
            "node", (F.coalesce("strength", F.lit(0.0)) == 0).alias("dangling"), salts.alias("salts")),
        "nodes", {"n": F.count(F.lit(1)), "d": F.count_if("dangling")})
    n = seen["n"]
    if n == 0:
        return spark.createDataFrame([], "node string, pagerank double")

    # every node also links to itself without passing rank: that link carries
    # the node's own columns, so a round needs one join and one aggregation
    # a source with very many edges meets its strength in several tasks
    pre = F.pmod(F.xxhash64("dst"), F.lit(_PRE_SALTS)).cast("int")
    known = out.where("strength <> 0").withColumn("salts", salts).withColumn("__pre", F.explode(F.sequence(F.lit(0), F.lit(_PRE_SALTS - 1))))
    links = edges.withColumn("__pre", pre).join(known, ["src", "__pre"]).select(
        "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst",
        (F.col("weight") / F.col("strength")).alias("p"), F.lit(0.0).alias("own"), F.lit(None).cast("int").alias("salts"))
    links = links.unionByName(nodes.select(
        F.col("node").alias("src"), F.lit(0).alias("salt"), F.col("node").alias("dst"), F.lit(0.0).alias("p"),
        F.lit(1.0).alias("own"), "salts"))
    parts = cfg.graph_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = links.repartition(parts, "src", "salt").persist(StorageLevel.MEMORY_AND_DISK)

    try:
        return _iterate(spark, nodes, links, n, seen["d"] / n, cfg)
    finally:
        links.unpersist()


def _iterate(spark, nodes: DataFrame, links: DataFrame, n: int, mass: float, cfg: TraceConfig) -> DataFrame:
    k, alpha = cfg.rounds_per_write, cfg.damping
    facts = nodes.select("node", "dangling")  # later with the constant vector's columns w0..
    ranks = nodes.select("node", "salts", F.lit(1.0 / n).alias("v0"))
    w_mass, rounds, old = None, 0, None
    while True:
        block = ranks
        for j in range(k):
            block = _follow(block, links, j, alpha)
        path = new_path(spark, "ranks")
        table, sums = staged(
            block.join(facts, "node"), "ranks",
            {f"d{j}": F.sum(F.when(F.col("dangling"), F.col(f"v{j}")).otherwise(0.0)) for j in range(k + 1)}, path)
        if w_mass is None:  # the first ranks are the constant vector over n
            w_mass = [sums[f"d{j}"] * n for j in range(k)]
            facts = table.select("node", "dangling", *[(F.col(f"v{j}") * F.lit(float(n))).alias(f"w{j}") for j in range(k)])
            table = table.withColumns({f"w{j}": F.col(f"v{j}") * F.lit(float(n)) for j in range(k)})
        elif old:
            drop_path(spark, old)
        old = path if rounds else None  # the first table keeps the constant vector
        masses, added = [mass], []
        for j in range(1, k + 1):
            added.append(alpha * masses[-1] / n + (1 - alpha) / n)
            masses.append(sums[f"d{j}"] + sum(c * w_mass[j - 1 - i] for i, c in enumerate(added)))
        true = [F.col("v0")]
        for j in range(1, k + 1):
            rank = F.col(f"v{j}")
            for i, c in enumerate(added[:j]):
                rank = rank + F.lit(c) * F.col(f"w{j - 1 - i}")
            true.append(rank)
        change = table.agg(*[F.sum(F.abs(true[j] - true[j - 1])).alias(f"e{j}") for j in range(1, k + 1)]).first()
        usable = min(k, cfg.max_rounds - rounds)
        last = next((j for j in range(1, usable + 1) if change[f"e{j}"] < n * cfg.tolerance), None)
        if last is None and rounds + k < cfg.max_rounds:
            rounds += k
            mass, ranks = masses[k], table.select("node", "salts", true[k].alias("v0"))
            continue
        if last is None:
            message = f"PageRank stopped after {cfg.max_rounds} rounds without settling"
            if cfg.on_unsettled == "error":
                raise RuntimeError(message)
            warnings.warn(message)
        return table.select("node", true[last or usable].alias("pagerank"))


def _follow(block: DataFrame, links: DataFrame, j: int, alpha: float) -> DataFrame:
    """Next column v(j+1): what every node receives of column v(j) over its links."""
    held = [f"v{i}" for i in range(j + 1)]
    spread = block.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *held)
    return links.join(spread, ["src", "salt"]).groupBy(F.col("dst").alias("node")).agg(
        F.max("salts").alias("salts"), *[F.sum(F.col("own") * F.col(v)).alias(v) for v in held],
        (F.lit(alpha) * F.sum(F.col("p") * F.col(f"v{j}"))).alias(f"v{j + 1}"))


def neighbourhood(edges: DataFrame, node: str, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` undirected steps of a node, with their distance.
    Edges, frontier and reached nodes are written each hop, so that the plan of
    a hop reads three tables however many went before."""
    both = staged(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both-ways")
    reached = frontier = local_table(edges.sparkSession, [(node, 0)], "node string, hop int")
    for hop in range(1, hops + 1):
        ahead = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = staged(ahead.join(reached, "node", "left_anti").select("node", F.lit(hop).alias("hop")), "frontier")
        reached = staged(reached.unionByName(frontier), "reached")
    return reached


def select_nodes(nodes: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Nodes whose property, as text, is among the values."""
    return nodes.where(F.col(column).cast("string").isin(*values)).select("node")


def select_edge_ends(edges: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Endpoints of the edges whose property, as text, is among the values."""
    return node_set(edges.where(F.col(column).cast("string").isin(*values)))
