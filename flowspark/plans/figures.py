"""The tables behind every figure of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowspark.operators import alerts, curves
from flowspark.operators.quantiles import sample_exact


def figure_tables(preds: DataFrame, theta_rf: float = 0.5, sample_id: str = "sample_id", max_rows: int | None = None) -> dict[str, DataFrame]:
    """Confusion counts, curves, calibration, sweep, histograms and alert shares
    of stored predictions. Score histograms use a sample when asked to."""
    out: dict[str, DataFrame] = {"confusion": curves.confusion_counts(
        preds, "y_true", {"rf": (preds.rf_prob >= theta_rf).cast("int"), "ensemble": "final_binary"})}
    for score in ("rf_prob", "risk_score"):
        out[f"roc_{score}"] = curves.roc_curve(preds, score, "y_true")
        out[f"auc_{score}"] = curves.roc_auc(preds, score, "y_true")
        out[f"pr_{score}"] = curves.pr_curve(preds, score, "y_true")
        out[f"pr_area_{score}"] = curves.pr_area(preds, score, "y_true")
        out[f"calibration_{score}"] = curves.calibration_bins(preds, score, "y_true")
    out["threshold"] = curves.threshold_sweep(preds, "risk_score", "y_true")
    out["alerts"] = alerts.alert_distribution(preds, "y_true")
    shown = sample_exact(preds, max_rows, sample_id) if max_rows else preds
    for score in ("rf_prob", "unsup_score", "risk_score"):
        span = (None, None) if score == "unsup_score" else (0.0, 1.0)
        out[f"hist_{score}"] = curves.histogram(shown, score, 40, *span, by=["y_true"])
    return out
