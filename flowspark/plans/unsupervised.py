"""Unsupervised scoring: isolation forest, two reconstruction models, fusions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowspark.config import UnsupervisedConfig
from flowspark.functions.scalars import quoted
from flowspark.operators import fusion
from flowspark.operators.alerts import per_class_recall
from flowspark.operators.clean import column_medians, impute, scale_stats, standardise
from flowspark.operators.iforest import fit_iforest, score_iforest
from flowspark.operators.ordering import with_ids
from flowspark.operators.recon import fit_reconstruction, score_reconstruction
from flowspark.operators.selection import pca_variance, select_features
from flowspark.operators.thresholds import as_dict, evaluate_bundle, flag_columns, threshold_bundle
from flowspark.staging import staged

DETECTORS = {"iforest": "iforest_score", "ae": "ae_score", "vae": "vae_score"}
# which detectors each fusion joins, in the order they are compared
FUSIONS = {"IF+AE": ("iforest", "ae"), "IF+VAE": ("iforest", "vae"), "AE+VAE": ("ae", "vae"), "IF+AE+VAE": ("iforest", "ae", "vae")}


@dataclass
class UnsupervisedModels:
    features: list
    medians: dict
    scaling: dict
    forest: DataFrame
    ae: dict
    vae: dict


@dataclass
class UnsupervisedRun:
    models: UnsupervisedModels
    pca: DataFrame
    history: DataFrame
    thresholds: dict
    metrics: DataFrame
    fusions: DataFrame
    best_fusion: str
    per_class: DataFrame
    predictions: DataFrame


def fit_unsupervised(flows: DataFrame, features: Sequence[str], cfg: UnsupervisedConfig = UnsupervisedConfig()):
    """Select features on train; fit medians, scaling and models on benign train rows."""
    cols = cfg.columns
    label = cols.binary_label
    train = flows.where("split_binary = 'train'")
    chosen = select_features(train, features, label, cfg)
    benign = train.where(F.col(quoted(label)) == 0)
    medians = column_medians(benign, chosen)
    benign = impute(benign, medians)
    scaling = scale_stats(benign, chosen)
    benign = staged(standardise(benign, scaling), "benign")
    val = standardise(impute(flows.where("split_binary = 'val'"), medians), scaling)
    pca = pca_variance(benign, chosen, cfg.pca_variance)
    forest = fit_iforest(benign, chosen, cols.sample_id, cfg)
    ae, ae_history = fit_reconstruction(benign, val, chosen, label, False, cfg)
    vae, vae_history = fit_reconstruction(benign, val, chosen, label, True, cfg)
    history = ae_history.withColumn("model", F.lit("ae")).unionByName(vae_history.withColumn("model", F.lit("vae")))
    return UnsupervisedModels(chosen, medians, scaling, forest, ae, vae), pca, history


def raw_scores(flows: DataFrame, models: UnsupervisedModels, keep: Sequence[str]) -> DataFrame:
    """All three scores; every detector passes the row on to the next."""
    x = standardise(impute(flows, models.medians), models.scaling)
    out = score_iforest(x, models.forest, models.features, [*keep, *models.features], "iforest_score")
    out = score_reconstruction(out, models.ae, [*keep, *models.features, "iforest_score"], "ae_score")
    return score_reconstruction(out, models.vae, [*keep, "iforest_score", "ae_score"], "vae_score")


def unsupervised_score(flows: DataFrame, features: Sequence[str], cfg: UnsupervisedConfig = UnsupervisedConfig()) -> UnsupervisedRun:
    """Fit, score, fuse; thresholds from validation, flags for the test split."""
    cols = cfg.columns
    label, sid = cols.binary_label, cols.sample_id
    flows = with_ids(flows, sid)
    models, pca, history = fit_unsupervised(flows, features, cfg)
    held = flows.where("split_binary in ('val', 'test')")
    keep = [c for c in (sid, label, cols.label, "split_binary") if c in flows.columns]
    scored = staged(raw_scores(held, models, keep), "scores")
    val = scored.where("split_binary = 'val'")

    table, names = scored, dict(DETECTORS)
    ranges = fusion.score_ranges(val, list(DETECTORS.values()))
    parts = {name: [DETECTORS[p] for p in members] for name, members in FUSIONS.items()}
    found = fusion.compare_fusions(val, parts, label)
    for i, (name, weights, _) in enumerate(found):
        table = fusion.fuse(table, parts[name], weights, ranges, f"fused_{i}")
        names[name] = f"fused_{i}"
    fusions = flows.sparkSession.createDataFrame([(n, list(w), a) for n, w, a in found], "name string, weights array<double>, val_auc double")
    best = fusion.best_fusion(found)

    table = staged(table, "fused")
    thresholds, metrics = {}, None
    for name, score in names.items():
        val, test = (table.where(F.col("split_binary") == s) for s in ("val", "test"))
        thresholds[name] = as_dict(threshold_bundle(
            val, score, label, cfg.precision_target, cfg.recall_target, percentile=cfg.default_percentile))
        for split, part in (("val", val), ("test", test)):
            m = evaluate_bundle(part, score, label, thresholds[name]).withColumns({"model": F.lit(name), "split": F.lit(split)})
            metrics = m if metrics is None else metrics.unionByName(m)

    test = table.where("split_binary = 'test'")
    per_class = None
    if cols.label in test.columns:
        for name in [*DETECTORS, found[best][0]]:
            p = per_class_recall(test, names[name], thresholds[name]["best_f1"], cols.label).withColumn("model", F.lit(name))
            per_class = p if per_class is None else per_class.unionByName(p)
    preds = test.select(quoted(sid), F.col(quoted(label)).alias("y_true"), *DETECTORS.values(),
                        F.col(f"fused_{best}").alias("best_ensemble_score"))
    for name, score in DETECTORS.items():
        preds = flag_columns(preds, score, thresholds[name], f"{name}_pred_")
    preds = flag_columns(preds, "best_ensemble_score", thresholds[found[best][0]], "best_ensemble_pred_")
    return UnsupervisedRun(models, pca, history, thresholds, metrics, fusions, found[best][0], per_class, preds)
