from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.config import FlowColumns, TraceConfig
from flowspark.operators import campaigns, display, edges, graph, reconcile, summary, threat

EDGES = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]


def power_iteration(rows, alpha=0.85, tol=1e-6):
    names = sorted({n for r in rows for n in r[:2]})
    n = len(names)
    m = np.zeros((n, n))
    for s, t, w in rows:
        m[names.index(s), names.index(t)] += w
    out = m.sum(axis=1)
    x = np.full(n, 1 / n)
    p = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
    while True:
        last, x = x, alpha * (x @ p + x[out == 0].sum() / n) + (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            return dict(zip(names, x))


@pytest.mark.parametrize("cfg", [TraceConfig(), TraceConfig(hot_degree=1), TraceConfig(graph_parts=3, hot_degree=2), TraceConfig(rounds_per_write=1), TraceConfig(rounds_per_write=3)])
def test_pagerank_with_a_dangling_node(spark, cfg):
    df = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    got = {r.node: r.pagerank for r in graph.pagerank(df, cfg).collect()}
    want = power_iteration(EDGES)
    assert got == pytest.approx(want, abs=1e-12) and sum(got.values()) == pytest.approx(1.0)


def test_pagerank_of_nothing_and_of_zero_weights(spark):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.pagerank(empty).count() == 0
    rows = [("a", "b", 0.0), ("b", "a", 1.0)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    assert {r.node: r.pagerank for r in graph.pagerank(df).collect()} == pytest.approx(power_iteration(rows), abs=1e-12)


def test_pagerank_warns_when_it_does_not_settle(spark):
    df = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    with pytest.warns(UserWarning, match="without settling"):
        graph.pagerank(df, TraceConfig(max_rounds=2, tolerance=0.0))


@pytest.fixture()
def detail(spark):
    rows = [
        (1, "a", "x", "CRITICAL", 0.9, 0.95, "DoS"), (2, "a", "x", "MEDIUM", 0.3, 0.2, "DoS"), (3, "a", "x", "MEDIUM", 0.5, 0.4, "DoS"),
        (4, "a", "y", "HIGH", 0.7, 0.6, " benign "), (5, None, "y", "HIGH", 0.7, 0.6, "DoS"), (6, "b", None, "MEDIUM", 0.2, 0.2, None),
        (7, "b", "x", "LOW", 0.0, 0.0, "BENIGN")]
    return spark.createDataFrame(rows, "sample_id long, `Source IP` string, `Destination IP` string, alert_level string, risk_score double, rf_prob double, Label string")


def test_edge_means_are_those_of_the_first_level(detail):
    got = {(r.src, r.dst): r for r in graph.alerts_map(graph.attack_graph(detail)).collect()}
    assert set(got) == {("a", "x"), ("a", "y")}
    assert got["a", "x"].flow_count == 3 and got["a", "x"].avg_risk == 0.9
    assert got["a", "x"].alerts == {"CRITICAL": 1, "MEDIUM": 2}


def ranking(spark):
    return spark.createDataFrame([("a", 0.8, "attacker", 1), ("b", 0.1, "attacker", 2)], "`Source IP` string, threat_score double, role string, rank int")


def test_campaigns_skip_benign_and_unlabelled(spark, detail):
    rank = ranking(spark)
    assert [(r.ip, r.attack_type, r.total_flows, r.n_targets) for r in campaigns.campaigns(detail, rank).collect()] == [("a", "DoS", 3, 1)]
    assert [r.path for r in campaigns.campaign_targets(detail, rank).collect()] == ["a -> x"]
    assert {r.ip: r.total_attack_flows for r in campaigns.campaign_sources(detail, rank).collect()} == {"a": 4, "b": 1}


def test_campaigns_without_labels(spark, detail):
    got = campaigns.campaigns(detail.drop("Label"), ranking(spark)).collect()
    assert {(r.ip, r.attack_type, r.total_flows) for r in got} == {("a", "unknown", 4), ("b", "unknown", 1)}


def test_empty_timeline(spark, detail):
    rank = ranking(spark).withColumn("role", F.lit("normal"))
    df = detail.withColumn("Timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert display.timeline(df, rank).count() == 0


def test_node_fallbacks(spark):
    cols = FlowColumns()
    base = spark.createDataFrame([("f", "id1", 80, 1), ("f", "id1", 80, 0)], "source_file string, `Flow ID` string, `Destination Port` int, binary_label int")
    got = edges.edge_table(base, cols).first()
    assert (got.src_node, got.dst_node, got.src_node_type, got.dst_node_type, got.flow_count, got.attack_flow_ratio) == ("f", "id1", "file", "flow", 2, 0.5)
    assert edges.edge_table(base.drop("Flow ID"), cols).first().dst_node == "80"
    assert edges.edge_table(base.select("binary_label"), cols) is None
    unlabelled = edges.edge_table(base.drop("binary_label"), cols).first()
    assert unlabelled.attack_flow_count is None and unlabelled.attack_flow_ratio is None
    ips = spark.createDataFrame([(None, "d", None, 1), (None, "d", None, 0)], "`Source IP` string, `Destination IP` string, Protocol int, binary_label int")
    got = edges.edge_table(ips, cols).collect()
    assert len(got) == 1 and got[0].src_node == "nan" and got[0].flow_count == 2


def test_two_hops(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("e", "f")], "src string, dst string")
    assert {r.node: r.hop for r in graph.neighbourhood(df, "a", 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_rank_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "`Source IP` string, threat_score double")
    assert {r["Source IP"]: r["rank"] for r in threat.rank_sources(df).collect()} == {"c": 1, "a": 2, "b": 3}


def test_schema_difference(spark):
    gen = spark.createDataFrame([("a", 1)], "src_ip string, other int")
    lab = spark.createDataFrame([("f", "a", "b", 1, "L")], "`Flow ID` string, `Source IP` string, `Destination IP` string, Odd int, Label string")
    got = {(r.status, r.labelled, r.generated) for r in reconcile.schema_difference(gen, lab).collect()}
    assert got == {("mapped", "Source IP", "src_ip"), ("absent", "Destination IP", "dst_ip"), ("unmapped", "Odd", None), ("extra", None, "other")}
    assert reconcile.to_generated_names(lab).columns == ["Flow ID", "src_ip", "dst_ip", "Odd", "Label"]
    with pytest.raises(reconcile.ColumnsMissing):
        reconcile.match_flows(gen, lab)
    with pytest.raises(reconcile.ColumnsMissing):
        reconcile.match_flows(gen, gen)


def test_first_matching_spelling_wins(spark):
    gen = spark.createDataFrame([("1", "2", 3, 4, 6)] * 3 + [("9", "9", 1, 1, 6)], "src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    lab = spark.createDataFrame([(0, "1-2-3-4-6", "late"), (1, "2-1-4-3-6", " DoS "), (2, "2-1-4-3-6", "other")], "sample_id long, `Flow ID` string, Label string")
    matches = reconcile.match_flows(gen, lab)
    assert reconcile.match_summary(matches).first() == (4, 3, 0.75)
    assert [(r.label, r.n) for r in reconcile.matched_labels(matches).collect()] == [("DoS", 3)]


def test_flow_detail_parses_times_of_the_test_split(spark):
    trace = spark.createDataFrame([(1, "7/4/2017 9:05", "test"), (2, "x", "train")], "sample_id long, Timestamp string, split_binary string")
    preds = spark.createDataFrame([(1, "HIGH"), (2, "LOW")], "sample_id long, alert_level string")
    rows = summary.flow_detail(trace, preds).collect()
    assert len(rows) == 1 and rows[0].Timestamp.hour == 9


