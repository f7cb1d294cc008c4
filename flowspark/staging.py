"""Tables written to the shared checkpoint folder to cut lineage.

A staged table is computed once, survives the loss of any executor and has an
exact size, so Spark's own broadcast threshold decides joins against it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, types as T


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="flowspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staging_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/flowspark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{staging_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str = "table", observe: dict | None = None, path: str | None = None):
    """Write ``df`` once and return the written table.

    With ``observe`` (name -> aggregate column) the aggregates are computed
    while writing and returned as a dict next to the table.
    """
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    schema = df.schema
    metrics = None
    if observe:
        metrics = Observation()
        df = df.observe(metrics, *[c.alias(n) for n, c in observe.items()])
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    return (table, metrics.get) if observe else table


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="flowspark-py-"), "flowspark")
    # built next to the driver; Spark copies it to the workers
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    _shipped.add(app)


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def release(spark: SparkSession) -> None:
    """Remove every table this session has staged."""
    fs, p = file_system(spark, staging_folder(spark))
    fs.delete(p, True)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
          "array<double>": pa.list_(pa.float64())}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a table whose size Spark knows, so that its
    broadcast threshold applies; rows passed as Python tuples have no size."""
    fields = T.StructType.fromDDL(schema).fields
    columns = [pa.array([r[i] for r in rows], type=_ARROW[f.dataType.simpleString()]) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[f.name for f in fields]))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove one staged table that nothing reads any more."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
