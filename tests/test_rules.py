"""Null keys, absent ids, unsettled ranks, and models that hang on their rows only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowspark.config import SupervisedConfig, TraceConfig, UnsupervisedConfig
from flowspark.fixtures import SNAKE
from flowspark.operators import forest, graph, iforest, reconcile, split
from flowspark.operators.ordering import with_ids
from flowspark.sources.tables import read_columns


def test_missing_part_gives_no_flow_id(spark):
    generated = spark.createDataFrame([("a", "b", 80, 443, 6), ("a", "b", None, 443, 6)], "src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    labelled = spark.createDataFrame([(0, "b-a-80-443-6", "X"), (1, "b-a-443-6", "wrong"), (2, "b-a-443-80-6", "Y")], "sample_id long, `Flow ID` string, Label string")
    got = {r["src_port"]: (r["flow_id"], r["label"]) for r in reconcile.match_flows(generated, labelled).collect()}
    assert got == {80: ("b-a-443-80-6", "Y"), None: (None, None)}


def test_null_class_is_named(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(20)], "sample_id long, binary_label int")
    with pytest.raises(ValueError, match="1 rows have no class"):
        split.stratified_split(df, "binary_label", "s")


def test_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("v")).repartition(7)
    got = with_ids(df, "sample_id").toPandas()
    assert sorted(got.sample_id) == list(range(1000)) and sorted(got.v) == [3 * i for i in range(1000)]
    assert with_ids(df, "v") is df


def test_absent_column_reads_all(spark, tmp_path):
    spark.range(5).select("id", (F.col("id") * 2).alias("b")).write.parquet(f"{tmp_path}/t")
    with pytest.warns(UserWarning, match="absent"):
        assert read_columns(spark, f"{tmp_path}/t", ["id", "zzz"]).columns == ["id", "b"]
    assert [r["b"] for r in read_columns(spark, f"{tmp_path}/t", ["b"], rows=2).collect()] == [0, 2]


def test_unsettled_ranks_can_be_an_error(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 2.0), ("a", "c", 3.0)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError, match="without settling"):
        graph.pagerank(edges, TraceConfig(max_rounds=1, on_unsettled="error"))


def test_plan_of_a_hop_stays_small(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10)], "src string, dst string")
    out = graph.neighbourhood(edges, "0", 4)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 2
    assert {(r["node"], r["hop"]) for r in out.collect()} == {(str(i), i) for i in range(5)}


def _table(spark):
    rows = [(i, float((i * 37) % 101), float((i * 53) % 89), int((i * 37) % 101 > 60)) for i in range(900)]
    return spark.createDataFrame(rows, "sample_id long, a double, b double, binary_label int")


@pytest.mark.parametrize("parts", [2, 7])
def test_models_do_not_hang_on_partitions(spark, parts):
    rows, names = _table(spark), ["a", "b"]
    cfg = SupervisedConfig(columns=SNAKE, num_trees=4, max_depth=4)

    def scores(df):
        model = forest.fit_forest(df, names, cfg)
        nodes = iforest.fit_iforest(df, names, cfg=UnsupervisedConfig(columns=SNAKE, iforest_trees=7, iforest_sample=32))
        out = iforest.score_iforest(rows, nodes, names, ["sample_id"]).join(forest.score_attacks(model, rows, names, ["sample_id"]), "sample_id")
        assert nodes.where("depth = 0").select("tree", "size").distinct().count() == 7
        return {r["sample_id"]: (r["iforest_score"], r["attack_prob"]) for r in out.collect()}

    assert scores(rows.repartition(1)) == scores(rows.repartition(parts))
