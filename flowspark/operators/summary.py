"""Per-source summaries of scored flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowspark.config import FlowColumns
from flowspark.functions.scalars import quoted, to_timestamp


def rows_of_test(df: DataFrame) -> DataFrame:
    """Rows of the test split, all rows when the table has no split."""
    return df.where(F.col("split_binary") == "test") if "split_binary" in df.columns else df


def flow_detail(trace: DataFrame, preds: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Trace rows of the test split with their predictions, by unique id, and
    with times parsed."""
    fresh = [c for c in preds.columns if c == cols.sample_id or c not in trace.columns]
    if cols.timestamp in trace.columns and isinstance(trace.schema[cols.timestamp].dataType, T.StringType):
        trace = trace.withColumn(cols.timestamp, to_timestamp(cols.timestamp))
    return rows_of_test(trace).join(preds.select(*[quoted(c) for c in fresh]), cols.sample_id, "inner")


def _mean(c: str) -> Column:
    return F.avg(F.col(quoted(c)).cast("double"))


def supervised_summary(df: DataFrame, cols: FlowColumns = FlowColumns(), ip_ratio: float = 0.5) -> DataFrame:
    """Flows, flagged shares and mean probability per source, with source flags."""
    out = df.groupBy(F.col(quoted(cols.src_ip))).agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("pred_default").cast("long").alias("pred_attack_flows_default"),
        _mean("pred_default").alias("pred_attack_ratio_default"),
        _mean("pred_high_precision").alias("pred_attack_ratio_high_precision"),
        _mean("pred_high_recall").alias("pred_attack_ratio_high_recall"),
        _mean("attack_prob").alias("avg_attack_prob"),
        _mean("y_true").alias("true_attack_ratio"),
    )
    return out.withColumns({
        f"ip_is_attack_{n}": (F.col(f"pred_attack_ratio_{n}") >= F.lit(ip_ratio)).cast("int")
        for n in ("default", "high_precision", "high_recall")
    })


def unsupervised_summary(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Per source, from the fused score where it exists, else the autoencoder's."""
    score = "best_ensemble_score" if "best_ensemble_score" in df.columns else "ae_score"
    pred = "best_ensemble_pred_best_f1" if "best_ensemble_pred_best_f1" in df.columns else "ae_pred_best_f1"
    return df.groupBy(F.col(quoted(cols.src_ip))).agg(
        F.count(F.lit(1)).alias("total_flows"), F.sum(pred).cast("long").alias("attack_flows"),
        _mean(pred).alias("attack_ratio"), _mean(score).alias("avg_score"),
        _mean("y_true").alias("true_attack_ratio"))


def ensemble_summary(df: DataFrame, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Per source: alert counts by level and mean scores."""
    level = F.col("alert_level")
    return df.groupBy(F.col(quoted(cols.src_ip))).agg(
        F.count(F.lit(1)).alias("total_flows"), F.sum("final_binary").cast("long").alias("attack_flows"),
        _mean("final_binary").alias("attack_ratio"),
        F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "MEDIUM").alias("medium"),
        _mean("risk_score").alias("avg_risk"), _mean("rf_prob").alias("avg_rf_prob"),
        _mean("unsup_score").alias("avg_unsup"))


def top_sources(summary: DataFrame, ratio: str, n: int = 10, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Report of the n most suspicious sources."""
    return summary.orderBy(F.col(ratio).desc(), F.col(quoted(cols.src_ip)).asc_nulls_last()).limit(n)
