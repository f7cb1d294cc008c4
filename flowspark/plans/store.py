"""Storing fitted models and the documents that describe a run."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession, functions as F

from flowspark.config import SupervisedConfig, UnsupervisedConfig
from flowspark.operators.recon import load_reconstruction, save_reconstruction
from flowspark.operators.trees import TreeModel, load_trees, save_trees
from flowspark.plans.fuse import AlertRun
from flowspark.plans.supervised import SupervisedRun
from flowspark.plans.unsupervised import UnsupervisedModels, UnsupervisedRun
from flowspark.sinks import manifest, save_predictions, write_document, write_names, write_table
from flowspark.sources.tables import read_feature_names, require
from flowspark.staging import local_table


def save_supervised(spark: SparkSession, run: SupervisedRun, features: list[str], folder: str, cfg: SupervisedConfig = SupervisedConfig()) -> None:
    """Model, feature list, predictions, thresholds, metrics and manifest."""
    save_trees(run.model, f"{folder}/supervised_trees")
    write_names(spark, features, f"{folder}/supervised_features")
    write_table(run.predictions, f"{folder}/test_predictions_supervised")
    write_document(manifest(spark, **run.thresholds), f"{folder}/supervised_thresholds")
    write_document(run.metrics, f"{folder}/metrics_supervised")
    settings = {k: v for k, v in asdict(cfg).items() if k != "columns"}
    write_document(manifest(spark, feature_cols=features, n_features=len(features), hyperparams=settings, thresholds=run.thresholds, kind=run.model.kind),
                   f"{folder}/model_manifest")


def save_unsupervised_models(spark: SparkSession, models: UnsupervisedModels, folder: str) -> None:
    write_names(spark, models.features, f"{folder}/selected_features")
    rows = [(c, models.medians[c], *map(float, models.scaling[c])) for c in models.features]
    write_table(local_table(spark, rows, "feature string, median double, mean double, deviation double"), f"{folder}/scaler")
    write_table(models.forest, f"{folder}/iforest")
    save_reconstruction(spark, models.ae, f"{folder}/autoencoder")
    save_reconstruction(spark, models.vae, f"{folder}/vae")


def save_unsupervised(spark: SparkSession, run: UnsupervisedRun, folder: str, cfg: UnsupervisedConfig = UnsupervisedConfig()) -> None:
    """Models, predictions, thresholds, metrics, histories and manifest."""
    save_unsupervised_models(spark, run.models, folder)
    write_table(run.predictions, f"{folder}/test_predictions_unsupervised")
    thresholds = {n.replace("+", "_"): t for n, t in run.thresholds.items()}
    write_document(manifest(spark, **thresholds, best_ensemble=run.best_fusion), f"{folder}/unsupervised_thresholds")
    for name, table in (("metrics_unsupervised", run.metrics), ("training_history", run.history), ("pca_analysis", run.pca), ("fusions", run.fusions)):
        write_document(table, f"{folder}/{name}")
    if run.per_class is not None:
        write_document(run.per_class, f"{folder}/per_attack_analysis")
    settings = {k: v for k, v in asdict(cfg).items() if k != "columns"}
    write_document(manifest(spark, active_features=run.models.features, n_features=len(run.models.features),
                            hyperparams=settings, best_ensemble=run.best_fusion), f"{folder}/unsupervised_manifest")


def save_alert_run(spark: SparkSession, run: AlertRun, folder: str) -> None:
    """Predictions with the review export, fusion settings, metrics, summary."""
    save_predictions(run.predictions, folder)
    settings = asdict(run.config)
    settings["unsup_weights"] = dict(zip(("IF", "AE", "VAE"), run.config.unsup_weights))
    write_document(manifest(spark, config=settings), f"{folder}/ensemble_config")
    for split, tables in run.metrics.items():
        for name, table in tables.items():
            write_document(table.withColumn("split", F.lit(split)), f"{folder}/metrics_ensemble/{split}/{name}")
    if run.summary is not None:
        write_table(run.summary, f"{folder}/ip_summary")


def load_models(spark: SparkSession, folder: str) -> tuple[TreeModel, list[str], UnsupervisedModels]:
    """Forest or boosted trees with their features, and all unsupervised models, as stored above."""
    for part in ("supervised_trees", "supervised_features", "selected_features", "scaler", "iforest", "autoencoder", "vae"):
        require(spark, f"{folder}/{part}", "load_models")
    scaler = {r.feature: r for r in spark.read.parquet(f"{folder}/scaler").collect()}  # one row per feature
    models = UnsupervisedModels(
        features=read_feature_names(spark, f"{folder}/selected_features"),
        medians={c: r.median for c, r in scaler.items()}, scaling={c: (r["mean"], r.deviation) for c, r in scaler.items()},
        forest=spark.read.parquet(f"{folder}/iforest"), ae=load_reconstruction(spark, f"{folder}/autoencoder"),
        vae=load_reconstruction(spark, f"{folder}/vae"))
    return load_trees(spark, f"{folder}/supervised_trees"), read_feature_names(spark, f"{folder}/supervised_features"), models
