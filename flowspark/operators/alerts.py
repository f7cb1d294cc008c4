"""Four-level alerts: calibration, assignment and evaluation."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flowspark.config import ALERT_NAMES, BENIGN, AlertConfig
from flowspark.functions.scalars import (
    alert_code, alert_name, at_least, detection_source, is_attack, quoted, risk_score, round_even, share,
)
from flowspark.operators.curves import confusion_metrics, counts_from_cut, model_comparison
from flowspark.operators.quantiles import exact_quantiles
from flowspark.staging import local_table


def assign_alerts(df: DataFrame, cfg: AlertConfig = AlertConfig(), rf: str = "rf_prob", unsup: str = "unsup_score") -> DataFrame:
    """Alert code, name, collapsed decision, risk and source of detection."""
    return df.withColumn("alert_level_code", alert_code(rf, unsup, cfg)).withColumns({
        "alert_level": alert_name("alert_level_code"),
        "final_binary": is_attack("alert_level_code"),
        "risk_score": risk_score(rf, unsup, cfg),
        "detection_source": detection_source("alert_level_code"),
    })


def prediction_table(df: DataFrame, label: str, sample_id: str = "sample_id") -> DataFrame:
    """The stored form of alerted flows, scores rounded to six digits."""
    return df.select(
        quoted(sample_id), F.col(quoted(label)).alias("y_true"),
        round_even("rf_prob", 6).alias("rf_prob"), round_even("unsup_score", 6).alias("unsup_score"),
        "alert_level", "alert_level_code", "final_binary",
        round_even("risk_score", 6).alias("risk_score"), "detection_source")


def medium_flows(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("alert_level") == "MEDIUM")


# --- calibration -------------------------------------------------------------


def gray_grid() -> list[float]:
    return [float(g) for g in np.arange(0.02, 0.50, 0.01)]


def extreme_grid() -> list[float]:
    return [float(t) for t in np.arange(0.50, 0.999, 0.005)]


def calibrate_gray(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig(), rf: str = "rf_prob", min_rows: int = 10) -> DataFrame:
    """Lower edge of the gray zone: most attack rate times log of its size."""
    zone = df.where(F.col(rf) < F.lit(cfg.theta_rf))
    cuts = counts_from_cut(zone, rf, label, gray_grid()).where(F.col("n") >= min_rows)
    goal = (F.col("attacks") / F.col("n")) * F.log1p(F.col("n").cast("double"))
    best = F.max(F.struct(goal.alias("goal"), (-F.col("cut")).alias("low")))
    return cuts.agg(F.coalesce(-best["low"], F.lit(0.15)).alias("theta_gray"))


def calibrate_high(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig(), rf: str = "rf_prob", unsup: str = "unsup_score", percent: float = 25.0) -> DataFrame:
    """Percentile of the unsupervised score among the forest's true positives,
    and the share of them at or above it."""
    hits = df.where((F.col(rf) >= F.lit(cfg.theta_rf)) & (F.col(quoted(label)) == 1))
    cut = exact_quantiles(hits, [unsup], [percent / 100.0])[unsup, percent / 100.0]
    theta = cfg.theta_unsup_high if cut is None else cut
    return hits.agg(
        F.lit(theta).alias("theta_unsup_high"),
        F.coalesce(F.avg((F.col(unsup) >= F.lit(theta)).cast("double")), F.lit(0.0)).alias("critical_share"))


def calibrate_extreme(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig(), rf: str = "rf_prob", unsup: str = "unsup_score", min_rows: int = 3) -> DataFrame:
    """Cut that rescues most attacks below the gray zone at an acceptable
    attack rate; the 99.5th percentile where no cut does."""
    low = df.where(F.col(rf) < F.lit(cfg.theta_gray))
    fallback = exact_quantiles(low, [unsup], [0.995])[unsup, 0.995]
    fallback = cfg.theta_unsup_extreme if fallback is None else fallback
    cuts = counts_from_cut(low, unsup, label, extreme_grid()).where(
        (F.col("n") >= min_rows) & (F.col("attacks") > 0)
        & (F.col("attacks") / F.col("n") >= F.lit(cfg.medium_min_attack_ratio)))
    best = F.max(F.struct(F.col("attacks"), (-F.col("cut")).alias("low")))
    return cuts.agg(F.coalesce(-best["low"], F.lit(fallback)).alias("theta_unsup_extreme"))


def calibrate(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig()) -> AlertConfig:
    """All three cut points; each one sees those found before it."""
    cfg = replace(cfg, theta_gray=calibrate_gray(df, label, cfg).first()[0])
    cfg = replace(cfg, theta_unsup_high=calibrate_high(df, label, cfg).first()[0])
    return replace(cfg, theta_unsup_extreme=calibrate_extreme(df, label, cfg).first()[0])


# --- evaluation --------------------------------------------------------------


def alert_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows, attacks, attack ratio and share for all four levels."""
    counted = df.groupBy("alert_level_code").agg(F.count(F.lit(1)).alias("n"), F.sum(quoted(label)).cast("long").alias("a"))
    levels = local_table(df.sparkSession, list(ALERT_NAMES.items()), "alert_level_code int, alert_level string")
    all_levels = levels.join(counted, "alert_level_code", "left")  # four rows
    from pyspark.sql import Window as W

    total = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy())
    return all_levels.select(
        "alert_level", F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("a", F.lit(0)).alias("attacks"),
        share("a", "n", 6).alias("attack_ratio"), F.bround(F.coalesce(F.try_divide("n", total), F.lit(0.0)) * 100, 2).alias("pct"))


def medium_analysis(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig(), rf: str = "rf_prob") -> DataFrame:
    """What the MEDIUM level holds and how many forest misses it rescues."""
    y = F.col(quoted(label))
    medium = F.col("alert_level_code") == 1
    missed = (at_least(rf, cfg.theta_rf) == 0) & (y == 1)
    out = df.agg(
        F.count_if(medium).alias("medium_total"), F.count_if(medium & (y == 1)).alias("medium_attacks"),
        F.count_if(missed).alias("rf_fn_total"), F.count_if(missed & medium).alias("rescued_by_medium"),
        F.count_if((F.col("final_binary") == 1) & (y == 1)).alias("tp"), F.count_if(y == 1).alias("attacks"))
    return out.select(
        "medium_total", "medium_attacks", share("medium_attacks", "medium_total", 4).alias("medium_attack_ratio"),
        "rf_fn_total", "rescued_by_medium",
        F.bround(F.col("rescued_by_medium") / F.greatest(F.col("rf_fn_total"), F.lit(1)), 4).alias("rescue_rate"),
        share(F.col("tp") + F.col("medium_attacks"), "attacks", 6).alias("extended_recall"))


def per_attack_levels(df: DataFrame, label: str) -> DataFrame:
    """Alert levels and recall per attack class; the benign class is left out."""
    name = F.trim(F.col(quoted(label)))
    counts = [F.count_if(F.col("alert_level") == n).alias(n.lower()) for n in ALERT_NAMES.values()]
    out = df.where(F.coalesce(name != BENIGN, F.lit(True))).groupBy(name.alias("attack_type")).agg(F.count(F.lit(1)).alias("total"), *counts)
    detected = F.col("critical") + F.col("high")
    return out.withColumns({"detected": detected, "recall": share(detected, "total", 4)})


def per_class_recall(df: DataFrame, score: str, threshold: float, label: str) -> DataFrame:
    """Flagged share per class at one threshold, the benign class included."""
    hit = at_least(score, threshold)
    return df.groupBy(F.trim(F.col(quoted(label))).alias("attack_type")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(hit).cast("long").alias("detected")
    ).withColumn("recall", share("detected", "total", 4))


def detector_metrics(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig(), rf: str = "rf_prob") -> DataFrame:
    """Forest alone against the fused alert decision."""
    return confusion_metrics(
        df, label, {"rf_alone": at_least(rf, cfg.theta_rf), "ensemble": "final_binary"},
        {"rf_alone": rf, "ensemble": "risk_score"})


def detector_comparison(df: DataFrame, label: str, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    return model_comparison(detector_metrics(df, label, cfg), "rf_alone", "ensemble")
