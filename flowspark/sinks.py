"""Writers: partitioned tables, feature lists and JSON documents."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowspark.config import FlowColumns
from flowspark.functions.scalars import quoted
from flowspark.operators.alerts import medium_flows
from flowspark.operators.edges import edge_table, trace_metadata
from flowspark.operators.split import label_mapping
from flowspark.staging import file_system


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers to NULL at any depth."""
    return df.select(*[_safe(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema])


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.StructType):
        parts = [_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _safe(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType))
    return c


def to_json_lines(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row, NULL fields kept."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[quoted(c) for c in safe.columns]), {"ignoreNullFields": "false"}).alias(name))


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines; a one-row frame is a document."""
    json_safe(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_names(spark: SparkSession, names: Sequence[str], path: str, mode: str = "overwrite") -> None:
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode(mode).text(path)


def manifest(spark: SparkSession, **facts) -> DataFrame:
    """One-row document with the time of writing and the given facts."""
    facts = {"created_at": datetime.now(timezone.utc).isoformat(), **facts}
    columns = []
    for name, value in facts.items():
        columns.append(_literal(value).alias(name))
    return spark.range(0, 1, 1, 1).select(*columns)


def _literal(value) -> Column:
    if isinstance(value, Mapping):
        return F.struct(*[_literal(v).alias(str(k)) for k, v in value.items()]) if value else F.lit(None).cast("string")
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value]) if value else F.lit(None).cast("array<string>")
    return F.lit(value)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, **facts) -> str:
    """Write the tables of a run so that they appear together, and return the run's name.

    Everything goes to a folder of the run, with a manifest of paths, row
    counts and facts. Last of all one small file that names the run is put in
    the place of the former one by a rename. A run that breaks before that
    leaves what readers see as it was.
    """
    run = f"run-{uuid.uuid4().hex}"
    for name, table in tables.items():
        write_table(table, f"{folder}/{run}/{name}")
    rows = {name: spark.read.parquet(f"{folder}/{run}/{name}").count() for name in tables}
    write_document(manifest(spark, run=run, tables={n: {"path": f"{run}/{n}", "rows": c} for n, c in rows.items()}, facts=facts), f"{folder}/{run}/manifest")
    jvm = spark.sparkContext._jvm
    fs, path = file_system(spark, f"{folder}/CURRENT")
    fresh = file_system(spark, f"{folder}/{run}/CURRENT")[1]
    out = fs.create(fresh, True)
    out.write(bytearray(run.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, path, how)
    return run


def published(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and manifest of the run published last; an error if a table lacks rows."""
    run = spark.read.text(f"{folder}/CURRENT").first()[0]
    document = spark.read.json(f"{folder}/{run}/manifest")
    tables = {}
    for name, entry in document.first()["tables"].asDict(True).items():
        tables[name] = spark.read.parquet(f"{folder}/{entry['path']}")
        if tables[name].count() != entry["rows"]:
            raise ValueError(f"{name} of {run} has not the rows of its manifest")
    return tables, document


def save_prepared(df: DataFrame, features: Sequence[str], folder: str, cols: FlowColumns = FlowColumns()) -> None:
    """Split tables, feature tables, feature list, label map, trace and edges.

    One table partitioned by the binary split stands for all split files.
    """
    spark = df.sparkSession
    write_table(df, f"{folder}/flows", by=["split_binary"])
    stored = spark.read.parquet(f"{folder}/flows")
    only = [quoted(c) for c in features]
    write_table(stored.select(*only), f"{folder}/features_full")
    write_table(benign_train(stored, features, cols), f"{folder}/features_benign_train")
    write_names(spark, features, f"{folder}/feature_names")
    write_document(label_document(stored, cols), f"{folder}/label_mapping")
    write_table(trace_metadata(stored, cols), f"{folder}/trace_metadata", by=["split_binary"])
    edges = edge_table(stored, cols)
    if edges is not None:
        write_table(edges, f"{folder}/trace_edges")


def benign_train(df: DataFrame, features: Sequence[str], cols: FlowColumns = FlowColumns()) -> DataFrame:
    keep = F.col("split_binary") == "train"
    if cols.binary_label in df.columns:
        keep = keep & (F.col(quoted(cols.binary_label)) == 0)
    return df.where(keep).select(*[quoted(c) for c in features])


def label_document(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Both label spaces as one row of maps (classes are few)."""
    pairs = F.sort_array(F.collect_list(F.struct("code", "label")))
    as_map = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["code"].cast("string"), p["label"])))
    binary = F.create_map(F.lit("0"), F.lit("BENIGN"), F.lit("1"), F.lit("ATTACK (all non-BENIGN labels)"))
    return label_mapping(df, cols).agg(as_map.alias(cols.label)).select(binary.alias(cols.binary_label), quoted(cols.label))


def save_predictions(preds: DataFrame, folder: str) -> None:
    """Predictions, and the MEDIUM rows for review when there are any."""
    write_table(preds, f"{folder}/predictions")
    medium = medium_flows(preds.sparkSession.read.parquet(f"{folder}/predictions"))
    if not medium.isEmpty():
        write_table(medium, f"{folder}/suspicious_flows_medium")


def save_trace(
    ranking: DataFrame, sources: DataFrame, campaigns: DataFrame, targets: DataFrame, evidence: DataFrame,
    stats: DataFrame, folder: str, ip: str = "Source IP",
) -> None:
    """Ranking table, attack-path tables keyed by source and attack type, graph
    statistics, top-10 report and evidence records."""
    write_table(ranking, f"{folder}/attack_ip_ranking")
    write_document(sources, f"{folder}/attack_sources")
    write_document(campaigns, f"{folder}/attack_campaigns")
    write_document(targets, f"{folder}/attack_targets")
    write_document(evidence, f"{folder}/evidence_chains")
    spark = ranking.sparkSession
    counts = {r.stat: r.n for r in stats.collect()}
    top = ranking.orderBy("rank").limit(10).select(
        "rank", F.col(quoted(ip)).alias("ip"), "threat_score", "role", "attack_ratio").collect()
    report = manifest(spark, summary=counts, ip_ranking_top10=[r.asDict() for r in top])
    write_document(report, f"{folder}/attack_summary_report")
