"""The stages in a row, on flows written as raw CSVs."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from flowspark import fixtures as fx, sinks
from flowspark.config import AlertConfig, FlowColumns, SupervisedConfig, UnsupervisedConfig
from flowspark.operators.alerts import assign_alerts, prediction_table
from flowspark.plans import figures, fuse, prepare, store, supervised, trace, unsupervised
from flowspark.sources import tables
from flowspark.streaming.alert_stream import alert_stream


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plan")
    df = fx.flows(spark, SF)
    df.select(
        F.col("source_ip").alias(" Source IP"), F.col("destination_ip").alias("Destination IP"),
        F.col("destination_port").alias("Destination Port"), F.date_format("flow_ts", "M/d/yyyy H:mm").alias("Timestamp"),
        F.col("flow_value").alias("Flow Bytes/s"), F.col("unsup_score").alias("Flow IAT Max"),
        (F.col("binary_label") * 0.3 + F.col("rf_prob")).alias("Idle Mean"), F.lit(3).alias("Idle Min"), F.col("label").alias(" Label"),
    ).write.option("header", True).csv(str(root / "raw"))
    features = prepare.run_prepare(spark, str(root / "raw"), str(root / "out"))
    return root, features


def test_prepared_outputs(spark, ready):
    root, features = ready
    assert features == ["Flow Bytes/s", "Flow IAT Max", "Idle Mean"]
    flows = spark.read.parquet(str(root / "out/flows"))
    assert flows.count() == 1000 and {r[0] for r in flows.select("split_binary").distinct().collect()} == {"train", "val", "test"}
    assert tables.read_feature_names(spark, str(root / "out/feature_names")) == features
    text = json.loads(next(Path(root / "out/label_mapping").glob("*.json")).read_text())
    assert text["Label"] == {"0": "BENIGN", "1": "DoS", "2": "PortScan"} and text["binary_label"]["0"] == "BENIGN"
    edges = spark.read.parquet(str(root / "out/trace_edges"))
    assert edges.agg(F.sum("flow_count")).first()[0] == 1000 and edges.where("first_seen is null").isEmpty()
    benign = spark.read.parquet(str(root / "out/features_benign_train"))
    assert benign.columns == features and benign.count() == flows.where("split_binary = 'train' and binary_label = 0").count()
    pruned = tables.read_split(spark, str(root / "out/flows"), "test")
    assert "PartitionFilters: [isnotnull(split_binary" in pruned._jdf.queryExecution().toString()


def test_all_stages(spark, ready, tmp_path):
    root, features = ready
    flows = spark.read.parquet(str(root / "out/flows"))
    sup = supervised.supervised_score(flows, features, SupervisedConfig(num_trees=5, max_depth=4))
    assert sup.metrics.count() == 9 and set(sup.thresholds) == {"default", "high_precision", "high_recall"}
    n_test = flows.where("split_binary = 'test'").count()
    assert sup.predictions.count() == n_test
    un = unsupervised.unsupervised_score(flows, features, UnsupervisedConfig(iforest_trees=10, iforest_sample=32, epochs=1, bottleneck=2))
    assert un.fusions.count() == 4 and un.metrics.count() == 7 * 2 * 4 and un.predictions.count() == n_test
    assert {"iforest_pred_default", "vae_pred_best_f1", "best_ensemble_score", "best_ensemble_pred_high_recall"} <= set(un.predictions.columns)
    stored = spark.read.parquet(str(root / "out/trace_metadata"))
    run = fuse.fuse_and_alert(flows, sup.model, features, un.models, stored)
    assert run.predictions.count() == n_test and run.config != AlertConfig()
    assert run.metrics["test"]["alert_distribution"].agg(F.sum("count")).first()[0] == n_test
    models = str(tmp_path / "models")
    store.save_supervised(spark, sup, features, models)
    store.save_unsupervised(spark, un, models)
    store.save_alert_run(spark, run, str(tmp_path / "p"))
    forest, names, stored_models = store.load_models(spark, models)
    again = fuse.fuse_and_alert(flows, forest, names, stored_models)
    assert again.config == run.config and again.predictions.exceptAll(run.predictions).isEmpty()
    few = SupervisedConfig(boost_rounds=2, boost_depth=3)
    boosted = supervised.supervised_score(flows, features, few, boosted=True)
    store.save_supervised(spark, boosted, features, models, few)
    read_back = store.load_models(spark, models)[0]
    assert read_back.kind == "boosted" and read_back.trees == 2 and read_back.nodes.exceptAll(boosted.model.nodes).isEmpty()
    weights = json.loads(next((tmp_path / "p/ensemble_config").glob("*.json")).read_text())["config"]["unsup_weights"]
    assert sum(weights.values()) == pytest.approx(1.0)
    found = trace.trace_attacks(stored, run.predictions, run.summary)
    trace.save(found, str(tmp_path / "t"))
    ranking = spark.read.parquet(str(tmp_path / "t/attack_ip_ranking"))
    assert sorted(r[0] for r in ranking.select("rank").collect()) == list(range(1, ranking.count() + 1))
    report = json.loads(next(Path(tmp_path / "t/attack_summary_report").glob("*.json")).read_text())
    assert report["summary"]["total_ips"] == ranking.count() and report["ip_ranking_top10"][0]["rank"] == 1
    shown = figures.figure_tables(run.predictions)
    assert all(t.count() >= 1 for t in shown.values())
    inputs = tmp_path / "in"
    run.summary.write.parquet(str(inputs / "ip_summary"))
    run.predictions.write.parquet(str(inputs / "predictions"))
    stored.write.parquet(str(inputs / "trace_metadata"))
    loaded = tables.load_trace_inputs(spark, str(inputs))
    assert "trace_edges" not in loaded and loaded["trace_metadata"].count() == n_test


def test_a_run_appears_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    first = sinks.publish(spark, {"a": spark.range(3), "b": spark.range(5)}, folder, cut=0.5)
    tables, document = sinks.published(spark, folder)
    assert tables["a"].count() == 3 and document.first()["facts"]["cut"] == 0.5 and document.first()["run"] == first
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(spark, {"a": spark.range(9), "b": broken}, folder)
    assert sinks.published(spark, folder)[0]["a"].count() == 3
    second = sinks.publish(spark, {"a": spark.range(7)}, folder)
    tables, document = sinks.published(spark, folder)
    assert set(tables) == {"a"} and tables["a"].count() == 7 and document.first()["run"] == second
    sinks.write_table(spark.range(2), f"{folder}/{second}/a")
    with pytest.raises(ValueError, match="has not the rows"):
        sinks.published(spark, folder)


def test_json_keeps_no_nan(spark):
    df = spark.sql("select double('nan') a, array(double('inf'), 1d) b, named_struct('c', float('-inf'), 'd', 'x') s, map('k', double('nan')) m, 3 i")
    assert json.loads(sinks.to_json_lines(df).first()[0]) == {"a": None, "b": [None, 1.0], "s": {"c": None, "d": "x"}, "m": {"k": None}, "i": 3}


def test_manifest(spark):
    row = json.loads(sinks.to_json_lines(sinks.manifest(spark, n=3, names=["a"], none=[], t={"x": 0.5, "y": None})).first()[0])
    assert row["n"] == 3 and row["names"] == ["a"] and row["none"] is None and row["t"] == {"x": 0.5, "y": None} and row["created_at"]


def test_missing_models(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="load_models"):
        store.load_models(spark, str(tmp_path))


def test_medium_export_only_when_needed(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.9, 0.9, 1), (2, 0.0, 0.1, 0)], "sample_id long, rf_prob double, unsup_score double, y int")
    sinks.save_predictions(prediction_table(assign_alerts(df), "y"), str(tmp_path))
    assert not (tmp_path / "suspicious_flows_medium").exists()


def test_stream_equals_batch(spark, tmp_path):
    df = fx.flows(spark, SF).select("sample_id", "rf_prob", "unsup_score", F.col("label").alias("Label"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = alert_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("alerted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got, want = spark.table("alerted"), alert_stream(df, cols=FlowColumns())
    assert got.count() == 1000 and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from flowspark import staging

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.checkpoint_root(session)
