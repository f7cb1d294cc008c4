"""Autoencoder and variational autoencoder, trained by synchronous mini-batches.

Rows are dealt to batches once, by their values. A step is one job: its batches
give their gradients where they are, an aggregate takes their row-weighted mean,
and the weights move once. The fit is that of one machine that runs the same
batches, for any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from flowspark.config import UnsupervisedConfig
from flowspark.functions.recon_net import Net
from flowspark.functions.scalars import quoted
from flowspark.operators.curves import roc_auc
from flowspark.staging import new_path, ship_package, staged


def _matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[quoted(c) for c in keep], F.array(*[F.col(quoted(c)).cast("double") for c in features]).alias("__x"))


def deal_batches(train: DataFrame, features: Sequence[str], cfg: UnsupervisedConfig) -> tuple[DataFrame, int]:
    """Rows with their batch, written by step, and the number of steps.

    A row's batch hangs on its values only, so that batches are the same for
    any partitions. A step takes ``sync_batches`` batches at once.
    """
    slim = _matrix(train, features).withColumn("key", F.xxhash64("__x"))
    batches = max(1, round(train.count() / cfg.batch_rows))
    steps = -(-batches // cfg.sync_batches)
    batch = F.pmod(F.xxhash64("key", F.lit(cfg.seed)), F.lit(batches)).cast("int")
    path = new_path(train.sparkSession, "batches")
    slim.withColumn("batch", batch).withColumn("step", F.col("batch") % steps).repartition("step", "batch").write.partitionBy("step").parquet(path)
    rows = train.sparkSession.read.schema("__x array<double>, key long, batch int, step int").parquet(path)
    return rows, steps


def pack_batches(rows: DataFrame) -> DataFrame:
    """(step, batch, n, data): each dealt batch as one row, its rows in the
    order of their keys, so that a step reads it as it is."""

    def pack(table: pa.Table) -> pa.Table:
        x = table["__x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        x = _ordered(x, table["key"].to_numpy())
        return pa.table({"step": table["step"][:1], "batch": table["batch"][:1], "n": pa.array([len(x)]), "data": pa.array([x.tobytes()], pa.binary())})

    path, kinds = new_path(rows.sparkSession, "packed"), "n long, data binary, step int, batch int"
    rows.groupBy("step", "batch").applyInArrow(pack, "step int, batch int, n long, data binary").select("n", "data", "step", "batch").write.partitionBy("step").parquet(path)
    return rows.sparkSession.read.schema(kinds).parquet(path)


def _ordered(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    return x[np.lexsort((*x.T, key))]


def batch_gradient(net: Net, flat: np.ndarray, x: np.ndarray, key: np.ndarray, batch: int, epoch: int, cfg: UnsupervisedConfig, beta: float) -> tuple[float, np.ndarray]:
    """Loss of one batch, and its gradient with the running statistics after it
    behind. Rows are taken in the order of their keys."""
    return _gradient(net, flat, _ordered(x, key), batch, epoch, cfg, beta)


def _gradient(net: Net, flat: np.ndarray, x: np.ndarray, batch: int, epoch: int, cfg: UnsupervisedConfig, beta: float) -> tuple[float, np.ndarray]:
    flat = flat.copy()
    loss, grad = net.loss_and_gradient(flat, x, beta, np.random.default_rng([cfg.seed, epoch, batch]))
    grad[net.trained:] = flat[net.trained:]
    return loss, grad


def _epoch(rows: DataFrame, net: Net, state: np.ndarray, steps: int, epoch: int, rate: float, cfg: UnsupervisedConfig, beta: float, in_epoch: int):
    """One pass over all rows, a job per step: every batch of the step gives a
    gradient at the same weights, their mean moves the weights once. Dealt rows
    are packed first where they are not yet. Returns state, steps so far and loss."""
    t, packed = net.trained, rows if "data" in rows.columns else pack_batches(rows)
    flat, first, second = state[:net.size].copy(), state[net.size:net.size + t].copy(), state[net.size + t:].copy()
    seen, loss_sum, width = 0.0, 0.0, net.encoder[0][0] if net.encoder else net.heads[0][0]
    for step in np.random.default_rng([cfg.seed, epoch]).permutation(in_epoch).tolist():
        shared = rows.sparkSession.sparkContext.broadcast(flat)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for n, batch, data in zip(*(part.column(c) for c in ("n", "batch", "data")), strict=True):
                    x = np.frombuffer(data.as_buffer()).reshape(-1, width)
                    loss, grad = _gradient(net, shared.value, x, batch.as_py(), epoch, cfg, beta)
                    yield pa.RecordBatch.from_arrays([pa.array([float(n.as_py())]), pa.array([loss * len(x)]), pa.array([grad], pa.list_(pa.float64()))], names=["rows", "loss", "grad"])

        found = packed.where(F.col("step") == step).select("n", "batch", "data").mapInArrow(gradient, "rows double, loss double, grad array<double>")
        if cfg.sync_batches > 1:
            mean = vector_to_array(Summarizer.mean(F.col("grad"), F.col("rows"))).alias("grad")
            found = found.withColumn("grad", array_to_vector("grad")).agg(F.sum("rows").alias("rows"), F.sum("loss").alias("loss"), mean)
        row = next(iter(found.toArrow().to_pylist()), None)  # of one batch, or the mean of all
        shared.unpersist()
        if row and row["rows"]:
            grad, steps = np.array(row["grad"]), steps + 1
            net.adam(flat, grad, first, second, steps, rate, cfg.weight_decay)
            flat[t:] = grad[t:]
            seen, loss_sum = seen + row["rows"], loss_sum + row["loss"]
    return np.concatenate([flat, first, second]), steps, loss_sum / max(seen, 1.0)


def fit_reconstruction(
    train: DataFrame, val: DataFrame, features: Sequence[str], label: str, variational: bool = False,
    cfg: UnsupervisedConfig = UnsupervisedConfig(),
) -> tuple[dict, DataFrame]:
    """Model and training history (epoch, loss, val_auc, lr).

    ``sync_batches`` batches of about ``batch_rows`` rows move the weights
    together; with 1 that is plain mini-batch training, more use more executors
    a step. The rate halves when the validation AUC stands still, training stops when
    it does for long, and the best state is kept.
    """
    ship_package(train.sparkSession)
    net = Net(len(features), cfg.bottleneck, cfg.hidden_layers, cfg.dropout, variational)
    rows, in_epoch = deal_batches(train, features, cfg)
    rows = pack_batches(rows)
    val = staged(val.select(quoted(label), *[quoted(c) for c in features]), "val")
    state = np.concatenate([net.start(cfg.seed), np.zeros(2 * net.trained)])
    rate, steps, best, best_auc, wait = cfg.learning_rate, 0, state, -1.0, 0
    plateau_best, plateau_wait, history = -np.inf, 0, []
    for epoch in range(1, cfg.epochs + 1):
        state, steps, loss = _epoch(rows, net, state, steps, epoch, rate, cfg, cfg.vae_beta, in_epoch)
        model = _model(net, state, features, cfg)
        auc = roc_auc(score_reconstruction(val, model, [label]), "recon_score", label).first().auc or 0.0
        if auc > plateau_best * (1 + 1e-4) if plateau_best > 0 else auc > plateau_best:
            plateau_best, plateau_wait = auc, 0
        else:
            plateau_wait += 1
        if plateau_wait > 5:
            rate, plateau_wait = max(rate * 0.5, 1e-6), 0
        history.append((epoch, float(loss), float(auc), float(rate)))
        if auc > best_auc:
            best, best_auc, wait = state, auc, 0
        else:
            wait += 1
        if wait >= cfg.patience:
            break
    table = train.sparkSession.createDataFrame(history, "epoch int, loss double, val_auc double, lr double")
    return _model(net, best, features, cfg), table


def _model(net: Net, state: np.ndarray, features: Sequence[str], cfg: UnsupervisedConfig) -> dict:
    return {"features": list(features), "bottleneck": cfg.bottleneck, "layers": cfg.hidden_layers,
            "dropout": cfg.dropout, "variational": net.variational, "weights": state[:net.size].tolist()}


def score_reconstruction(df: DataFrame, model: dict, keep: Sequence[str], name: str = "recon_score") -> DataFrame:
    """Mean squared reconstruction error per row."""
    ship_package(df.sparkSession)
    features = model["features"]
    net = Net(len(features), model["bottleneck"], model["layers"], model["dropout"], model["variational"])
    weights = df.sparkSession.sparkContext.broadcast(np.asarray(model["weights"]))

    def score(batches):
        for pdf in batches:
            out = pdf.drop(columns="__x")
            out[name] = net.errors(weights.value, np.stack(pdf["__x"].to_numpy())) if len(pdf) else np.zeros(0)
            yield out

    slim = _matrix(df, features, keep)
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in slim.schema if f.name != "__x")
    return slim.mapInPandas(score, f"{schema}, {name} double")


def save_reconstruction(spark, model: dict, path: str) -> None:
    spark.createDataFrame([model], "features array<string>, bottleneck int, layers int, dropout double, variational boolean, weights array<double>"
                          ).write.mode("overwrite").parquet(path)


def load_reconstruction(spark, path: str) -> dict:
    return spark.read.parquet(path).first().asDict()
