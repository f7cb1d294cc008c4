"""Fusing both detectors into four alert levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from flowspark.config import AlertConfig, FlowColumns
from flowspark.operators import alerts, fusion
from flowspark.operators.clean import impute_own
from flowspark.operators.forest import score_attacks
from flowspark.operators.ordering import with_ids
from flowspark.operators.summary import ensemble_summary, flow_detail
from flowspark.plans.unsupervised import DETECTORS, UnsupervisedModels, raw_scores
from flowspark.staging import staged


@dataclass
class AlertRun:
    config: AlertConfig
    predictions: DataFrame
    metrics: dict[str, dict[str, DataFrame]]
    summary: DataFrame | None


def both_scores(flows: DataFrame, forest, features: Sequence[str], models: UnsupervisedModels, cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Forest probability and the three anomaly scores of every flow. Gaps are
    filled from each split's own medians here, as the fusion stage does."""
    keep = [c for c in (cols.sample_id, cols.binary_label, cols.label) if c in flows.columns]
    wanted = list(dict.fromkeys([*features, *models.features]))
    filled = staged(impute_own(flows, wanted), "filled")
    rf = score_attacks(forest, filled, features, [cols.sample_id], "rf_prob")
    return raw_scores(filled, models, keep).join(rf, cols.sample_id)


def evaluate_alerts(df: DataFrame, label: str, cfg: AlertConfig, attack_label: str | None = None) -> dict[str, DataFrame]:
    out = {
        "alert_distribution": alerts.alert_distribution(df, label),
        "binary_metrics": alerts.detector_metrics(df, label, cfg),
        "comparison": alerts.detector_comparison(df, label, cfg),
        "medium_analysis": alerts.medium_analysis(df, label, cfg),
    }
    if attack_label is not None and attack_label in df.columns:
        out["per_attack"] = alerts.per_attack_levels(df, attack_label)
    return out


def fuse_and_alert(
    flows: DataFrame, forest, features: Sequence[str], models: UnsupervisedModels, trace: DataFrame | None = None,
    cfg: AlertConfig = AlertConfig(), cols: FlowColumns = FlowColumns(),
) -> AlertRun:
    """Weights and cuts from validation; alerts, metrics and source summary for test."""
    flows = with_ids(flows, cols.sample_id)
    val, test = (staged(both_scores(flows.where(F.col("split_binary") == s), forest, features, models, cols), s) for s in ("val", "test"))
    scores, label = list(DETECTORS.values()), cols.binary_label
    weights, _ = fusion.best_weights(fusion.search_weights(val, scores, label, fusion.grid_three_rest(), clip=True, flat=1e-12))
    cfg = replace(cfg, unsup_weights=weights)
    ranges = fusion.score_ranges(val, scores)
    val, test = (staged(fusion.fuse(d, scores, weights, ranges, "unsup_score", clip=True, flat=1e-12), "fused") for d in (val, test))
    cfg = alerts.calibrate(val, label, cfg)
    val, test = alerts.assign_alerts(val, cfg), alerts.assign_alerts(test, cfg)
    metrics = {"validation": evaluate_alerts(val, label, cfg), "test": evaluate_alerts(test, label, cfg, cols.label)}
    preds = staged(alerts.prediction_table(test, label, cols.sample_id), "predictions")
    summary = None
    if trace is not None and {cols.sample_id, cols.src_ip} <= set(trace.columns):
        summary = ensemble_summary(flow_detail(trace, preds, cols), cols)
    return AlertRun(cfg, preds, metrics, summary)

