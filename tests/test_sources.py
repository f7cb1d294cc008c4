from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from flowspark.config import PrepareConfig
from flowspark.operators import clean
from flowspark.plans.prepare import load_flows
from flowspark.sources import flow_csv, tables


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "dirty flows"
    d.mkdir()
    (d / "a.csv").write_text("Flow ID, Source IP,Destination IP , Flow Bytes/s,Const, Label\nf1,1.1.1.1,2.2.2.2,10,1,BENIGN\nf2,,2.2.2.2,20,1,  DoS \n", "utf-8")
    (d / "b.csv").write_bytes("Flow ID,Source IP,Destination IP,Flow Bytes/s,Const,Label\nf3,1.1.1.1,3.3.3.3,30,1,Web – XSS\n".encode("cp1252"))
    (d / "c.csv").write_text("Flow ID,Flow Bytes/s\nf4,1\n")
    (d / "d.csv").write_text(
        "Flow ID,Source IP,Destination IP,Flow Bytes/s,Const,Label\n"
        "g1,x,y,Infinity,1,DoS\ng2,x,y,-inf,1,DoS\ng3,x,y,NaN,1,DoS\ng4,x,y,abc,1,DoS\ng5,x,y,,1,DoS\ng6,x,y,1.5f,1,DoS\n"
        "g7,x,y,5,1, \ng8,x,y,5,1,\ng9,x,y,7,1,PortScan\n")
    (d / "notes.txt").write_text("no csv")
    return str(d)


def test_listing(spark, folder, tmp_path):
    assert [f.rsplit("/", 1)[1] for f in flow_csv.list_csv(spark, folder)] == ["a.csv", "b.csv", "c.csv", "d.csv"]
    with pytest.raises(FileNotFoundError):
        flow_csv.list_csv(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        flow_csv.list_csv(spark, str(tmp_path / "empty"))


def test_dirty_files(spark, folder):
    with pytest.warns(UserWarning, match="c.csv"):
        flows = load_flows(spark, folder)
    rows = flows.orderBy("sample_id").collect()
    assert [r["Flow ID"] for r in rows] == ["f1", "f2", "f3", "g1", "g2", "g3", "g4", "g5", "g6", "g9"]
    assert [r.sample_id for r in rows] == list(range(10))
    assert rows[2]["Label"] == "Web – XSS" and rows[1]["Source IP"] is None
    assert [r.binary_label for r in rows] == [0] + [1] * 9
    assert {r.source_file for r in rows} == {"a.csv", "b.csv", "d.csv"}
    cleaned, features = clean.clean_features(flows)
    assert features == ["Flow Bytes/s"]
    assert sorted(r["Flow ID"] for r in cleaned.collect()) == ["f1", "f2", "f3", "g9"]


def test_no_file_with_label(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(ValueError):
            flow_csv.read_flow_csvs(spark, flow_csv.list_csv(spark, str(tmp_path)))


def test_equal_headers_after_trimming(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a, a,Label\n1,2,L\n")
    df = flow_csv.read_flow_csvs(spark, flow_csv.list_csv(spark, str(tmp_path)))
    assert df.select("`a`", "`a.1`").first() == ("1", "2")


def test_genuine_replacement_character_is_utf8(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,Label\n�é,L\n", "utf-8")
    assert flow_csv.read_flow_csvs(spark, flow_csv.list_csv(spark, str(tmp_path))).first().a == "�é"


def test_encodings_by_cell(spark, tmp_path):
    """UTF-8 and code page 1252 in one file and across files of one header; nothing runs before the scan."""
    head = "Näme,Label\n"
    (tmp_path / "b.csv").write_bytes(head.encode("cp1252") + "é – €,L\n".encode("cp1252") + "é – €,L\n".encode() + b"plain,L\n\x81,L\n")
    (tmp_path / "c.csv").write_bytes(b"\n\n" + head.encode() + '"q, é",L\n'.encode("cp1252"))
    (tmp_path / "d.csv").write_bytes(b"")
    sc = spark.sparkContext
    sc.setJobGroup("csv headers", "")
    try:
        with pytest.warns(UserWarning, match="d.csv"):
            df = flow_csv.read_flow_csvs(spark, flow_csv.list_csv(spark, str(tmp_path)))
        assert not sc.statusTracker().getJobIdsForGroup("csv headers")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["source_file"], r["Näme"]) for r in df.collect()) == [
        ("b.csv", "plain"), ("b.csv", "\x81"), ("b.csv", "é – €"), ("b.csv", "é – €"), ("c.csv", "q, é")]


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + "Näme,Label\né,L\n".encode())
    (tmp_path / "b.csv").write_bytes("Näme,Label\n,L\n".encode())
    df = flow_csv.read_flow_csvs(spark, flow_csv.list_csv(spark, str(tmp_path)))
    assert df.columns == ["Näme", "Label", "source_file", "__block"]
    assert sorted((r["source_file"], r["Näme"]) for r in df.collect()) == [("a.csv", "é"), ("b.csv", None)]


def test_text_feature_drops_all_rows_unless_left_out(spark):
    df = spark.createDataFrame([("x", "1", "BENIGN"), ("y", "2", "DoS")], "t string, n string, Label string")
    with pytest.raises(ValueError):
        clean.clean_features(df)
    out, features = clean.clean_features(df, PrepareConfig(on_all_null="drop_column"))
    assert out.count() == 2 and features == ["n"]


def test_ids_over_many_blocks(spark, tmp_path):
    for k in range(5):
        spark.range(k * 100, k * 100 + 100).select("id", F.lit("DoS").alias("Label")).coalesce(1).write.option("header", True).csv(str(tmp_path / f"p{k}"))
    files = [f for k in range(5) for f in flow_csv.list_csv(spark, str(tmp_path / f"p{k}"))]
    df = flow_csv.with_sample_id(flow_csv.read_flow_csvs(spark, files))
    ids = sorted(r.sample_id for r in df.collect())
    assert ids == list(range(500))
    steps = df.withColumn("n", F.col("id").cast("long")).groupBy("source_file").agg(F.countDistinct(F.col("n") - F.col("sample_id")).alias("k")).collect()
    assert {r.k for r in steps} == {1}


def test_small_documents(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a\n\n  b \nc\n")
    assert tables.read_feature_names(spark, str(tmp_path / "names.txt")) == ["a", "b", "c"]
    (tmp_path / "none.txt").write_text("\n\n")
    with pytest.raises(ValueError):
        tables.read_feature_names(spark, str(tmp_path / "none.txt"))
    (tmp_path / "m.json").write_text('{"config": {"theta_rf": 0.4}, "x": 1}')
    assert tables.theta_rf(tables.read_document(spark, str(tmp_path / "m.json"))) == 0.4
    (tmp_path / "n.json").write_text('{"x": 1}')
    assert tables.theta_rf(tables.read_document(spark, str(tmp_path / "n.json"))) == 0.5
    (tmp_path / "t.json").write_text('{"metrics": {"a": 1, "b": {"value": 2.5}, "c": true, "d": "x", "e": {"v": 1}, "f": {"value": "3"}}, "z": 9}')
    assert {r.name: r.value for r in tables.flat_metrics(spark, str(tmp_path / "t.json")).collect()} == {"a": 1.0, "b": 2.5, "f": 3.0}
    (tmp_path / "u.json").write_text('{"a": 1, "metrics": 4}')
    assert {r.name: r.value for r in tables.flat_metrics(spark, str(tmp_path / "u.json")).collect()} == {"a": 1.0, "metrics": 4.0}


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.require(spark, str(tmp_path / "no"))
    with pytest.warns(UserWarning):
        assert not tables.require(spark, str(tmp_path / "no"), "roc", strict=False)


def test_latency_column(spark, tmp_path):
    (tmp_path / "l.csv").write_text("name,first,latency_ms\na,1,5\nb,2,\n")
    assert [r[0] for r in tables.read_latency(spark, str(tmp_path / "l.csv")).collect()] == [5.0]
    (tmp_path / "k.csv").write_text("name,first,second\na,1,5\nb,2,6\n")
    assert [r[0] for r in tables.read_latency(spark, str(tmp_path / "k.csv")).collect()] == [1.0, 2.0]
    (tmp_path / "j.csv").write_text("name\na\n")
    assert tables.read_latency(spark, str(tmp_path / "j.csv")) is None
