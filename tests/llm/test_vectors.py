"""Nearest neighbours and embedding near-dedup against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from flowspark.llm import ann, hnsw, vector_dups
from flowspark.llm.components import components

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_search_recall(spark, embeddings):
    got = ann.query(spark, SF).toPandas()
    t = embeddings.orderBy("vec_id").toPandas()
    x, ids = np.stack(t.embedding.values).astype(float), t.vec_id.values
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ann.distances(x, np.broadcast_to(x[q], x.shape))
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and (mine.score.values == d[np.searchsorted(ids, mine.vec_id)]).all()
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        d[q] = np.inf
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_search_ties_and_hot_list(spark):
    """A third of all rows are one vector: ties go to the smaller ids, blocks stay bounded."""
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(i, rng.normal(size=4).tolist()) for i in range(300, 900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, table.where("vec_id % 100 = 0"), config=ann.Config(block_rows=32, sample=64)).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 11))
    assert got[got.query_id == 200].sort_values("rank").vec_id.tolist() == list(range(10))


def test_search_in_small_parts(spark, embeddings):
    """How many rows and queries meet in a task does not change what is found."""
    asked = embeddings.where("vec_id % 20 = 0")
    found = [sorted(map(tuple, ann.nearest(embeddings, asked, config=ann.Config(block_rows=rows, query_rows=queries)).collect()))
             for rows, queries in ((4_096, 16_384), (4_096, 3), (50, 7))]
    assert found[0] == found[1]  # the same blocks
    assert len(found[2]) == len(found[0]) and len(set(found[2]) & set(found[0])) >= 0.99 * len(found[0])


_ODD = [(0, [1.0, 0.0], 1), (100, [1.0, 0.01], 1), (1, [1.0, 0.02], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [NAN, 1.0], 1), (5, [INF, 1.0], 1), (6, [1.0, None], 1),
        (7, [1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (200, None, 1), (10, [-1.0, 0.0], 1)]
_KIND = "vec_id long, embedding array<float>, label int"


def test_search_odd_vectors(spark):
    table = spark.createDataFrame(_ODD, _KIND)
    got = ann.nearest(table, table.where("vec_id % 100 = 0")).toPandas()
    assert sorted(set(got.query_id)) == [0, 100]
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [8, 9, 9, 100, 1, 10]
    empty = table.limit(0)
    assert ann.nearest(empty, empty).count() == 0
    assert ann.nearest(table, empty).count() == 0


def test_groups_odd_vectors(spark):
    table = spark.createDataFrame(_ODD, _KIND)
    got = {(r["vec_id"], r["component_id"], r["n_links"], r["kept"]) for r in vector_dups.vector_groups(table).collect()}
    assert {(0, 0, 2, True), (100, 0, 2, False), (1, 0, 2, False), (9, 9, 1, True), (8, 8, 0, True), (2, 2, 0, True), (10, 10, 0, True), (None, None, 0, True)} <= got
    assert vector_dups.vector_groups(table).count() == len(_ODD) and vector_dups.vector_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_groups_brute_force(spark, shard_rows):
    """Cliques of near copies, exact copies, chains, over one and several shards."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:5].repeat(30, 0) + 0.05 * rng.normal(size=(150, 16)), base[:3].repeat(10, 0), rng.normal(size=(60, 16))]).astype(np.float32)
    ids, labels = rng.permutation(len(x)).tolist(), [int(i % 2) for i in range(len(x))]
    table = spark.createDataFrame([(i, v.tolist(), l) for i, v, l in zip(ids, x, labels, strict=True)], _KIND)
    got = {r["vec_id"]: r for r in vector_dups.vector_groups(table, config=vector_dups.Config(shard_rows=shard_rows, beam=8)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == labels)
    np.fill_diagonal(link, False)
    reach = link | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == link[k].sum()
        assert got[i]["component_id"] == min(np.array(ids)[reach[k]])
        assert got[i]["kept"] == (got[i]["component_id"] == i)


def test_graph_reaches_all():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(700, 8)), rng.normal(size=8) + 0.01 * rng.normal(size=(900, 8))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = hnsw.Graph.load(hnsw.Graph.build(x, 2).dump())
    ids, _ = graph.search(x[:16], len(x))
    assert all(set(row.tolist()) == set(range(len(x))) for row in ids)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (2000, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if any(i in e for e in edges if e[0] != e[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("planted", [12, 2000])
def test_sparse_links_across_shards_are_met(planted):
    """Few and many planted pairs between two shards of real size, against brute force."""
    rng, c = np.random.default_rng(11), vector_dups.Config()
    x, q = vector_dups._unit(rng.normal(size=(c.shard_rows, 64))), vector_dups._unit(rng.normal(size=(c.shard_rows, 64)))
    at, to = rng.permutation(len(q))[:planted], rng.permutation(len(x))[:planted]
    q[at] = vector_dups._unit(x[to] + 0.045 * rng.normal(size=(planted, 64)))
    graph = hnsw.Graph.build(x, c.seed)
    beam = vector_dups._audited_beam(graph, q, None, vector_dups._planted_beam(graph, c), c)
    assert beam <= c.shard_rows // 8  # a graph's search, not a comparison with all
    met = {(int(a), int(b)) for r, p, _, whole in vector_dups._linked(graph, q, None, beam, c) for a, b in zip(r, p) if not whole}
    want = {(int(a), int(b)) for a, b in zip(at, to) if x[b] @ q[a] >= c.least}
    assert len(want) > 0.4 * planted
    assert len(want - met) <= 0.01 * planted


def test_beam_widens_until_the_audit_passes():
    """A poor graph (few links kept) and a narrow first beam: the beam doubles until planted points are met."""
    rng = np.random.default_rng(4)
    x = vector_dups._unit(rng.normal(size=(3_000, 48)))
    graph = hnsw.Graph.build(x, 1)
    graph.levels = graph.levels[-1:]
    base = graph.levels[0]
    base.links = hnsw._connected(x, np.where(np.arange(base.links.shape[1]) < 4, base.links, -1)[:, :8], np.arange(1))
    c = vector_dups.Config(beam=2)
    beam = vector_dups._planted_beam(graph, c)
    assert beam > 2
    q = vector_dups._unit(x + 0.03 * rng.normal(size=x.shape))
    met = {(int(a), int(b)) for r, p, _, _ in vector_dups._linked(graph, q, None, beam, c) for a, b in zip(r, p)}
    assert sum((i, i) in met for i in range(len(x))) >= 0.99 * len(x)


def test_dense_shard_is_counted_whole(spark):
    """Most of a label are near copies of each other: every link counts, no pairs are gathered."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + 0.02 * rng.normal(size=(700, 16)), rng.normal(size=(500, 16))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], _KIND)
    for rows in (300, 10_000):
        got = vector_dups.vector_groups(table, config=vector_dups.Config(shard_rows=rows)).toPandas().sort_values("vec_id")
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        assert got.n_links.tolist() == ((u @ u.T >= 0.93).sum(1) - 1).tolist()
        assert (got.component_id[:700] == 0).all()
