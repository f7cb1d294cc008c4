"""Embedding near-dedup with small-world graphs per shard.

Equal vectors of a label are one class from the start. The classes of a label
are dealt into shards of bounded size, each shard gets a graph, and every shard
is asked for the neighbours of all classes of its label, a shard of queries at
a time. Two audits set the beam, which doubles until both pass: queries planted
at the linking cosine from points of the shard must meet these points, which
measures recall also where hardly a vector has links; and real queries, compared
with all points, must meet all their links. A beam that is full of links is
widened for its query; a query that meets links to 1/64 of the shard is compared
with the shard, at no more than 64 comparisons a link. Cosines near the bound are verified in double precision. Links are counted per class and joined
within the task as they are found, so that a task holds no pairs of a dense
shard and sends one row per class; components are then united across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import Scratch, col
from flowspark.llm.components import components
from flowspark.llm.hnsw import BATCH, Graph
from flowspark.llm.vectors import cosines, matrix, usable, vector_size


@dataclass(frozen=True)
class Config:
    least: float = 0.93
    shard_rows: int = 16_384
    beam: int = 32
    #: Planted queries per shard, and real ones per shard and shard of queries, whose links must be met.
    planted: int = 1_024
    audits: int = 256
    #: Shares that must be met: of planted points, which lie as far off as a link may, and of real links.
    planted_recall: float = 0.999
    recall: float = 1.0
    seed: int = 5


_BLOCK = 256  # queries compared with all points at a time
_TILE = 1 << 16  # pairs verified at a time
_SLACK = 1e-4  # single precision is off by less
_WIDER = 8  # how much wider the beam of a query gets that is full of links
_DENSE = 64  # comparisons a link that cost less than one more search


def _linked(graph: Graph, q: np.ndarray, own: np.ndarray | None, beam: int, config: Config) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Queries, points and similarities of pairs that may link, some queries at
    a time, and whether these queries were compared with all points."""
    n, near = len(graph.x), config.least - _SLACK
    todo, width = np.arange(len(q)), min(beam, n)
    while len(todo):
        again, step = [], max(1, BATCH * 128 // max(width, 128))
        for i in range(0, len(todo), step):
            rows = todo[i : i + step]
            ids, sims = graph.search(q[rows], width, None if own is None else own[rows])
            full = (sims >= near).all(1) & (width < n)
            r, c = np.nonzero((sims >= near) & ~full[:, None])
            yield rows[r], ids[r, c], sims[r, c], False
            again.append(rows[full])
        todo = np.concatenate(again)
        if width * _DENSE >= n:
            break
        width *= _WIDER
    for i in range(0, len(todo), _BLOCK):
        rows = todo[i : i + _BLOCK]
        sims = q[rows] @ graph.x.T
        r, c = np.nonzero(sims >= near)
        yield rows[r], c, sims[r, c], True


def _wide_enough(graph: Graph, q: np.ndarray, own: np.ndarray | None, wanted: np.ndarray, beam: int, recall: float, config: Config) -> int:
    """``beam``, doubled until searches of ``q`` meet the share ``recall`` of the pairs ``wanted`` (query * points + point)."""
    n = len(graph.x)
    while beam < n and len(wanted):
        met = np.concatenate([r * n + c for r, c, _, _ in _linked(graph, q, own, beam, config)])
        if np.isin(wanted, met).sum() >= recall * len(wanted):
            break
        beam *= 2
    return min(beam, n)


def _planted_beam(graph: Graph, config: Config) -> int:
    """The beam that meets points of the graph from queries at the linking cosine from them."""
    rng, x = np.random.default_rng(config.seed), graph.x
    at = rng.permutation(len(x))[: config.planted]
    aside = rng.normal(size=(len(at), x.shape[1]))
    aside -= (aside * x[at]).sum(1, keepdims=True) * x[at]
    aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-30)
    q = _unit(config.least * x[at] + np.sqrt(max(0.0, 1 - config.least**2)) * aside)
    return _wide_enough(graph, q, None, np.arange(len(at)) * len(x) + at, config.beam, config.planted_recall, config)


def _audited_beam(graph: Graph, q: np.ndarray, own: np.ndarray | None, beam: int, config: Config) -> int:
    """The beam that meets all links of some of the queries."""
    rows = np.random.default_rng(config.seed).permutation(len(q))[: config.audits]
    r, c = np.nonzero(q[rows] @ graph.x.T >= config.least + _SLACK / 2)  # clear of rounding
    return _wide_enough(graph, q[rows], None if own is None else own[rows], r * len(graph.x) + c, beam, config.recall, config)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place each of ``n`` places reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new[new]]
        if (new == root).all():
            return root
        root = new


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


_FOUND = "node long, root long, links long"


def _search(graph_rows: pa.Table, queries: pa.Table, size: int, config: Config) -> pa.Table:
    empty = pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    if not graph_rows.num_rows or not queries.num_rows:
        return empty
    graph = Graph.load(graph_rows["graph"][0].as_py())
    nodes, weights = (np.frombuffer(graph_rows[k][0].as_py(), np.int64) for k in ("nodes", "weights"))
    vectors = np.frombuffer(graph_rows["vectors"][0].as_py(), np.float64).reshape(-1, size)
    qn, qx = queries["node"].to_numpy(), matrix(queries["vector"], size)
    order = np.argsort(nodes)
    at = np.minimum(np.searchsorted(nodes[order], qn), len(nodes) - 1)
    same = nodes[order][at] == qn  # queries of the graph's own shard start at themselves
    own = np.where(same, order[at], -1)
    q, n = _unit(qx), len(nodes)
    every, place = np.unique(np.concatenate([qn, nodes]), return_inverse=True)
    of_query, of_point = place[: len(qn)], place[len(qn) :]
    root, count = np.arange(len(every)), np.zeros(len(every), np.int64)

    def take(r: np.ndarray, c: np.ndarray) -> None:
        nonlocal root
        np.add.at(count, of_query[r], weights[c])
        a, b = root[of_query[r]], root[of_point[c]]
        root = _roots(len(every), a[a != b], b[a != b])[root]

    query_of, dense, few = np.full(n, -1), np.zeros(len(qn), bool), []
    query_of[own[same]] = np.flatnonzero(same)
    for r, c, sims, whole in _linked(graph, q, own, _audited_beam(graph, q, own, graph_rows["beam"][0].as_py(), config), config):
        ok = sims >= config.least + _SLACK
        near = np.flatnonzero(~ok)
        for i in range(0, len(near), _TILE):
            k = near[i : i + _TILE]
            ok[k] = cosines(qx[r[k]], vectors[c[k]]) >= config.least
        ok &= nodes[c] != qn[r]
        r, c = r[ok], c[ok]
        if whole:
            dense[r] = True
            take(r, c)
        else:
            few.append(r * n + c)
        if same.all():  # a link of the own shard counts at both ends, whichever met it
            few.append(query_of[c] * n + own[r])
    r, c = np.divmod(np.unique(np.concatenate(few)) if few else np.zeros(0, np.int64), n)
    take(r[~dense[r]], c[~dense[r]])
    some = (count > 0) | (root != np.arange(len(every)))
    some[root[some]] = True
    return pa.table({"node": every[some].astype(np.int64), "root": every[root[some]].astype(np.int64), "links": count[some]}) if some.any() else empty


def vector_groups(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", config: Config = Config()) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label link when their cosine is ``config.least`` or more.
    Vectors that are null, zero, of another length than most or with null or
    non-finite components, rows without a label and rows without an id link
    with nothing: their component is their own id and they are kept. Repeated
    rows are vectors of their own and link with each other. Ids may repeat.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = rows.select(col(vec_id).alias("vec_id"), col(vector).alias("vector"), col(label).alias("label"))
    size = vector_size(rows, "vector")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"), size)
    rows = rows.withColumn("ok", ok)
    classes = scratch.write(rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
                            .withColumn("node", F.monotonically_increasing_id()), "classes")
    shards = scratch.write(classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / config.shard_rows).cast("int").alias("shards")), "labels")
    dealt = classes.join(shards, "label").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    dealt = scratch.write(dealt.select("label", "shards", "shard", "node", "vector", "weight"), "dealt")

    def build(group: pa.Table) -> pa.Table:
        x = matrix(group["vector"], size)
        order = np.argsort(group["node"].to_numpy())
        x = x[order]
        graph = Graph.build(_unit(x), config.seed)
        blobs = {"graph": graph.dump(), "nodes": group["node"].to_numpy()[order].astype(np.int64).tobytes(),
                 "weights": group["weight"].to_numpy()[order].astype(np.int64).tobytes(), "vectors": x.astype(np.float64).tobytes()}
        return pa.table({"label": group["label"][:1], "shard": group["shard"][:1], "beam": pa.array([_planted_beam(graph, config)], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in blobs.items()}})

    kind = classes.schema["label"].dataType.simpleString()
    graphs = dealt.select("label", "shard", "node", "vector", "weight").groupBy("label", "shard").applyInArrow(build, f"label {kind}, shard int, beam int, graph binary, nodes binary, weights binary, vectors binary")
    graphs = scratch.write(graphs, "graphs")
    # every shard of a label meets every shard of queries of the label
    asked = dealt.select("label", F.col("shard").alias("part"), "node", "vector", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    spread = graphs.join(shards, "label").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    keys = ["label", "shard", "part"]
    found = scratch.write(spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda left, right: _search(left, right, size, config), _FOUND), "found")
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.write(named.join(least, "component").select(F.col("label").alias("__label"), F.col("vector").alias("__vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    scratch.drop(shards, dealt, graphs, found, classes)
    linked = rows.where("ok").join(named, (F.col("label") == F.col("__label")) & (F.col("vector") == F.col("__vector"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings where label is not null),
p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on r.b = p.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n_links from p group by a)
select c.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join n using (vec_id)
"""
