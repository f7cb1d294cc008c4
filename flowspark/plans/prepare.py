"""From raw flow CSVs to split, traced and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowspark.config import PrepareConfig
from flowspark.operators.clean import add_binary_label, clean_features, keep_labelled
from flowspark.operators.split import split_flows
from flowspark.sinks import save_prepared
from flowspark.sources.flow_csv import list_csv, read_flow_csvs, typed_trace_columns, with_sample_id
from flowspark.staging import staged


def load_flows(spark: SparkSession, folder: str, cfg: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Labelled rows of all CSVs with label code and ids. Ids are given before
    cleaning, so they may have gaps afterwards."""
    cols = cfg.columns
    raw = read_flow_csvs(spark, list_csv(spark, folder), cols.label, cols.source_file)
    labelled = add_binary_label(keep_labelled(raw, cols), cols)
    return typed_trace_columns(with_sample_id(labelled, cols.sample_id, cols.source_file), cols)


def prepare_flows(flows: DataFrame, cfg: PrepareConfig = PrepareConfig()) -> tuple[DataFrame, list[str]]:
    """Cleaned flows with both split columns, and the feature list."""
    cleaned, features = clean_features(flows, cfg)
    return split_flows(staged(cleaned, "clean"), cfg), features


def run_prepare(spark: SparkSession, folder: str, out: str, cfg: PrepareConfig = PrepareConfig()) -> Sequence[str]:
    """Read, clean, split and write everything later stages read."""
    flows, features = prepare_flows(load_flows(spark, folder, cfg), cfg)
    save_prepared(flows, features, out, cfg.columns)
    return features
