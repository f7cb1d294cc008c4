"""Labelled flow CSVs: many files, two encodings, differing headers.

Files are listed and their first lines read; everything else is one lazy scan.
Bytes are read as Latin-1, which keeps each of them, and every cell is decoded
where it is parsed, so no scan is needed to learn a file's encoding.
"""

from __future__ import annotations

import csv
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from flowspark.config import FlowColumns
from flowspark.functions.scalars import blank_to_null, quoted
from flowspark.staging import file_system, staged

# The characters of code page 1252 at 0x80..0x9F; five codes are unused.
CP1252_UPPER = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
_C1 = "".join(chr(c) for c in range(0x80, 0xA0))
_READERS = 16  # headers read at a time


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """All *.csv files of a folder in name order; an error when there are none."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        raise FileNotFoundError(f"no such folder: {folder}")
    found = sorted(s.getPath().toString() for s in fs.listStatus(path)
                   if s.isFile() and s.getPath().getName().endswith(".csv"))
    if not found:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return found


def _cp1252(text: Column) -> Column:
    """Latin-1 text to code page 1252."""
    return F.translate(text, _C1, CP1252_UPPER)


def _cell(raw: Column) -> Column:
    """Text of a cell read as Latin-1: its bytes as UTF-8 if they are that,
    else as code page 1252. Most cells are plain ASCII and stay as they are."""
    utf8 = F.encode(raw, "ISO-8859-1").cast("string")
    return F.when(F.octet_length(raw) == F.char_length(raw), raw).when(F.is_valid_utf8(utf8), utf8).otherwise(_cp1252(raw))


def _header(spark: SparkSession, file: str) -> str:
    """First filled line of a file; no more of it is read."""
    fs, path = file_system(spark, file)
    java = spark.sparkContext._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(fs.open(path), "ISO-8859-1"))
    try:
        line = reader.readLine()
        while line is not None and not line.strip(" "):
            line = reader.readLine()
    finally:
        reader.close()
    line = line or ""
    try:
        return line.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return line.translate(str.maketrans(_C1, CP1252_UPPER))


def _names(header: str) -> list[str]:
    """Trimmed header names; later equals get a numeric suffix."""
    seen: dict[str, int] = {}
    out = []
    for raw in next(csv.reader([header.lstrip("﻿")])):
        name = raw.strip()
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if k == 0 else f"{name}.{k}")
    return out


def read_flow_csvs(
    spark: SparkSession, files: Sequence[str], label: str | None = "Label", origin: str = "source_file"
) -> DataFrame:
    """Stack CSVs by column name as text columns, with their file name.

    Files with the same header share one scan, whatever their encodings: each
    cell is UTF-8 where its bytes are valid UTF-8 and code page 1252 otherwise.
    Files without the label column are left out; an error when none is left.
    With ``label=None`` all files are taken. Empty files have no columns. No
    job runs here.
    """
    with ThreadPoolExecutor(_READERS) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    groups: dict[tuple, list[str]] = {}
    for f, header in zip(files, headers, strict=True):
        names = tuple(_names(header)) if header else ()
        if label is not None and label not in names:
            warnings.warn(f"skipped, no column {label!r}: {f}")
            continue
        groups.setdefault(names, []).append(f)
    if not groups:
        raise ValueError(f"none of the files has a column {label!r}")
    out = None
    for names, paths in groups.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.csv(paths, schema=schema, header=True, enforceSchema=True, encoding="ISO-8859-1")
        part = raw.select(
            *[blank_to_null(_cell(F.col(f"c{i}"))).alias(n) for i, n in enumerate(names)],
            F.col("_metadata.file_name").alias(origin), F.col("_metadata.file_block_start").alias("__block"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_sample_id(df: DataFrame, sample_id: str = "sample_id", origin: str = "source_file") -> DataFrame:
    """Dense ids in file order.

    The table is written once; a row's id is the start of its file block plus
    its place in the written file, so ids do not depend on how later reads are
    split, and only one row per block is ever put in order.
    """
    keys = [c for c in (origin, "__block") if c in df.columns]
    table = staged(df, "flows")
    placed = table.select(
        "*", F.col("_metadata.file_name").alias("__part"), F.col("_metadata.row_index").alias("__row"))
    blocks = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    part_number = F.regexp_extract("__part", r"part-(\d+)", 1).cast("int")
    ahead = W.orderBy(*keys, part_number, "__part").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    start = F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")
    # written, hence of known size: Spark broadcasts it if it is small enough
    starts = staged(blocks.select(*keys, "__part", start.alias("__start")), "blocks")
    return placed.join(starts, [*keys, "__part"]).select(
        *[quoted(c) for c in df.columns if c != "__block"],
        (F.col("__start") + F.col("__row")).cast("long").alias(sample_id))


def typed_trace_columns(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Ports and protocol as integers."""
    return df.withColumns({c: F.col(quoted(c)).try_cast("double").try_cast("int") for c in (cols.src_port, cols.dst_port, cols.protocol) if c in df.columns})


def merge_captures(spark: SparkSession, folder: str) -> DataFrame:
    """All flow CSVs of a folder as one table, whatever their columns."""
    return read_flow_csvs(spark, list_csv(spark, folder), label=None).drop("__block", "source_file")
