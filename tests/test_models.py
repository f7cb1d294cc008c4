from __future__ import annotations

import itertools
import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.catalog import QUERIES
from flowspark.config import FlowColumns, SupervisedConfig, UnsupervisedConfig
from flowspark.functions.recon_net import Net, layer_widths
from flowspark.operators import clean, curves, explain, forest, iforest, recon, selection

COLS = FlowColumns(label="label")
NAMES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def blobs(spark):
    """Normal rows on a plane in six dimensions, a few rows off it."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 6)) + 0.05 * rng.normal(size=(600, 6))
    far = rng.normal(size=(60, 6)) * 4
    x = np.concatenate([base, far])
    y = np.r_[np.zeros(600, int), np.ones(60, int)]
    pdf = pd.DataFrame(x, columns=NAMES).assign(sample_id=np.arange(660), binary_label=y)
    return spark.createDataFrame(pdf).repartition(4).cache()


def test_average_path():
    assert iforest.average_path(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    assert float(iforest.average_path(256)) == pytest.approx(2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


@pytest.mark.parametrize("rows", [32, 6])
def test_isolation_forest_finds_outliers(blobs, rows):
    cfg = UnsupervisedConfig(iforest_trees=60, iforest_sample=rows)
    benign = blobs.where("binary_label = 0")
    nodes = iforest.fit_iforest(benign, NAMES, cfg=cfg)
    roots = nodes.where("node = 0").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).first()
    assert (roots.n, roots.lo, roots.hi) == (60, rows, rows)
    scored = iforest.score_iforest(blobs, nodes, NAMES, ["sample_id", "binary_label"])
    assert scored.count() == 660
    assert curves.roc_auc(scored, "iforest_score", "binary_label").first().auc > (0.85 if rows == 32 else 0.7)


def test_isolation_score_of_one_tree(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0, 0.5, 1, 2, 3, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, -1, 0.0, -1, -1, 2, 1)], iforest.NODE_SCHEMA)
    df = spark.createDataFrame([(1, 0.2), (2, 0.9)], "sample_id long, a double")
    got = {r.sample_id: r.iforest_score for r in iforest.score_iforest(df, nodes, ["a"], ["sample_id"]).collect()}
    c3 = float(iforest.average_path(3))
    assert got == pytest.approx({1: 2 ** (-1 / c3) - 0.5, 2: 2 ** (-2 / c3) - 0.5})


class Steady:
    """Same noise on every call, so that a loss can be differenced."""

    def random(self, shape):
        return np.random.default_rng(1).random(shape)

    def standard_normal(self, shape):
        return np.random.default_rng(2).standard_normal(shape)


@pytest.mark.parametrize("variational", [False, True])
def test_gradient(variational):
    net = Net(7, 3, 3, 0.15, variational)
    flat, x = net.start(1), np.random.default_rng(0).normal(size=(16, 7))
    _, grad = net.loss_and_gradient(flat.copy(), x, 0.5, Steady())
    for i in np.random.default_rng(5).choice(net.trained, 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (net.loss_and_gradient(up, x, 0.5, Steady())[0] - net.loss_and_gradient(down, x, 0.5, Steady())[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-7)


def test_layer_widths():
    assert layer_widths(50, 20, 3) == [50, 40, 30, 20]


@pytest.mark.parametrize("variational", [False, True])
def test_reconstruction_learns_and_flags(spark, blobs, variational, tmp_path):
    cfg = UnsupervisedConfig(columns=COLS, bottleneck=2, epochs=6, batch_rows=32, learning_rate=1e-2, vae_beta=0.01)
    benign = blobs.where("binary_label = 0")
    scaled = clean.standardise(blobs, clean.scale_stats(benign, NAMES))
    model, history = recon.fit_reconstruction(scaled.where("binary_label = 0"), scaled, NAMES, "binary_label", variational, cfg)
    rows = history.orderBy("epoch").collect()
    assert rows[-1].loss < rows[0].loss
    scored = recon.score_reconstruction(scaled, model, ["sample_id", "binary_label"])
    auc = curves.roc_auc(scored, "recon_score", "binary_label").first().auc
    assert auc > 0.8 and auc == pytest.approx(max(r.val_auc for r in rows), abs=1e-9)
    recon.save_reconstruction(spark, model, str(tmp_path / "m"))
    again = recon.score_reconstruction(scaled, recon.load_reconstruction(spark, str(tmp_path / "m")), ["sample_id"])
    gap = again.join(scored.withColumnRenamed("recon_score", "s"), "sample_id").agg(F.max(F.abs(F.col("recon_score") - F.col("s")))).first()[0]
    assert gap == 0.0


def test_rate_halves_and_training_stops(spark, blobs, monkeypatch):
    cfg = UnsupervisedConfig(columns=COLS, bottleneck=2, epochs=30, patience=9)
    monkeypatch.setattr(recon, "_epoch", lambda rows, net, state, *a: (state, 1.0, 0.0))
    _, history = recon.fit_reconstruction(blobs.limit(50), blobs, NAMES, "binary_label", False, cfg)
    rates = [r.lr for r in history.orderBy("epoch").collect()]
    assert len(rates) == 10 and rates[:6] == [1e-3] * 6 and rates[6:] == [5e-4] * 4


@pytest.mark.parametrize("name", ["recon_ae", "recon_vae"])
def test_registered_training_runs_until_it_settles(spark, monkeypatch, tmp_path, name):
    """With a validation score that stands still, training ends by its patience and by nothing before."""
    rng, epochs = np.random.default_rng(5), []
    rows = [(i, i % 4, rng.normal(size=64).astype(np.float32).tolist()) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(recon, "_epoch", lambda rows, net, state, steps, epoch, *a: (epochs.append(epoch), (state, 1.0, 0.0))[1])
    monkeypatch.setattr(recon, "roc_auc", lambda *a: SimpleNamespace(first=lambda: SimpleNamespace(auc=0.5)))
    assert QUERIES[name](spark, str(tmp_path)).count() == 120
    assert epochs == list(range(1, UnsupervisedConfig().patience + 2))


@pytest.mark.parametrize("variational,together", [(False, 1), (True, 3)])
def test_training_equals_one_machine(spark, blobs, variational, together):
    cfg = UnsupervisedConfig(columns=COLS, bottleneck=2, epochs=3, batch_rows=90, sync_batches=together)
    rows, steps = recon.deal_batches(blobs, NAMES, cfg)
    pdf = rows.toPandas()
    net = Net(6, 2, cfg.hidden_layers, cfg.dropout, variational)
    flat = net.start(cfg.seed)
    first, second, moved = np.zeros(net.trained), np.zeros(net.trained), 0
    for epoch in (1, 2, 3):
        for step in np.random.default_rng([cfg.seed, epoch]).permutation(steps):
            parts = [(len(b), *recon.batch_gradient(net, flat, np.stack(b["__x"]), b.key.to_numpy(), int(n), epoch, cfg, cfg.vae_beta)) for n, b in pdf[pdf.step == step].groupby("batch")]
            grad, moved = np.average([g for _, _, g in parts], 0, [n for n, _, _ in parts]), moved + 1
            net.adam(flat, grad, first, second, moved, cfg.learning_rate, cfg.weight_decay)
            flat[net.trained:] = grad[net.trained:]
    assert moved == 3 * steps and pdf.batch.nunique() == 7 and steps == -(-7 // together)
    for parts in (1, 7):
        table, in_epoch = recon.deal_batches(blobs.repartition(parts), NAMES, cfg)
        state, count = np.concatenate([net.start(cfg.seed), np.zeros(2 * net.trained)]), 0
        for epoch in (1, 2, 3):
            state, count, _ = recon._epoch(table, net, state, count, epoch, cfg.learning_rate, cfg, cfg.vae_beta, in_epoch)
        np.testing.assert_allclose(state[:net.size], flat, atol=1e-8)


def test_linear_residual(blobs):
    got = selection.linear_residual(blobs, blobs.where("binary_label = 0"), NAMES, ["binary_label"], 2)
    assert curves.roc_auc(got, "pca_score", "binary_label").first().auc > 0.95


def test_pca_variance_counts_needed_components(blobs):
    rows = selection.pca_variance(blobs.where("binary_label = 0"), NAMES, 0.95).orderBy("component").collect()
    assert [r.needed for r in rows] == [1, 1, 0, 0, 0, 0] and rows[-1].cumulative == pytest.approx(1.0)


def test_pca_plane_is_centred(blobs):
    row = selection.pca_plane(blobs, NAMES, ["binary_label"], rows=300).agg(F.count("*").alias("n"), F.avg("pc1").alias("a"), F.avg("pc2").alias("b")).first()
    assert row.n == 300 and row.a == pytest.approx(0, abs=1e-9) and row.b == pytest.approx(0, abs=1e-9)


def test_informative_feature_comes_first(blobs):
    df = blobs.withColumn("good", F.col("binary_label") + F.rand(1) * 0.5)
    cfg = UnsupervisedConfig(mi_top_k=1)
    assert selection.select_features(df, [*NAMES, "good"], "binary_label", cfg=cfg) == ["good"]
    assert selection.select_features(df, NAMES, "binary_label", cfg=UnsupervisedConfig(mi_top_k=50)) == NAMES


@pytest.fixture(scope="module")
def small_forest(blobs):
    return forest.fit_forest(blobs, NAMES, SupervisedConfig(columns=COLS, num_trees=5, max_depth=4))


def test_forest_is_repeatable_and_separates(blobs, small_forest):
    again = forest.fit_forest(blobs, NAMES, SupervisedConfig(columns=COLS, num_trees=5, max_depth=4))
    one = forest.score_attacks(small_forest, blobs, NAMES, ["sample_id", "binary_label"])
    two = forest.score_attacks(again, blobs, NAMES, ["sample_id", "binary_label"])
    assert one.exceptAll(two).isEmpty()
    assert curves.roc_auc(one, "attack_prob", "binary_label").first().auc > 0.9
    top = forest.importances(small_forest, NAMES, 3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance


def test_boosted_trees_separate(blobs):
    model = forest.fit_boosted(blobs, NAMES, SupervisedConfig(columns=COLS, boost_rounds=5, boost_depth=3))
    scored = forest.score_attacks(model, blobs, NAMES, ["binary_label"])
    assert curves.roc_auc(scored, "attack_prob", "binary_label").first().auc > 0.9


def test_odd_feature_names(blobs):
    df = blobs.withColumnsRenamed({"x0": "Flow Bytes/s", "x1": "a.b"})
    names = ["Flow Bytes/s", "a.b"]
    model = forest.fit_forest(df, names, SupervisedConfig(columns=COLS, num_trees=2, max_depth=2))
    assert forest.score_attacks(model, df, names, ["sample_id"]).count() == 660
    assert clean.standardise(clean.impute_own(df, names), clean.scale_stats(df, names)).select("`a.b`").count() == 660


@pytest.mark.parametrize("room", [10**6, 1])
def test_contributions_add_up_to_the_score(blobs, small_forest, room, monkeypatch):
    monkeypatch.setattr(explain, "NODES_PER_BLOCK", room)
    rows = blobs.where("sample_id % 20 = 0")
    got = explain.contributions(small_forest, rows, NAMES).groupBy("id").agg((F.sum("contribution") + F.first("base")).alias("p"))
    want = forest.score_attacks(small_forest, rows, NAMES, ["sample_id"])
    both = got.join(want, F.col("id") == F.col("sample_id"))
    assert both.count() == 33 and both.agg(F.max(F.abs(F.col("p") - F.col("attack_prob")))).first()[0] < 1e-12


def test_contributions_of_one_tree_by_enumeration():
    leaves = [(0.9, {0: (-np.inf, 0.5, 0.4), 1: (0.2, np.inf, 0.7)}), (0.1, {0: (-np.inf, 0.5, 0.4), 1: (-np.inf, 0.2, 0.3)}), (0.6, {0: (0.5, np.inf, 0.6)})]
    x = np.array([[0.3, 0.9], [0.8, 0.1]])
    phi, base = explain.tree_contributions(leaves, x)

    def value(row, known):
        total = 0.0
        for v, path in leaves:
            for f, (low, high, share) in path.items():
                v *= float(low < row[f] <= high) if f in known else share
            total += v
        return total

    for r, row in enumerate(x):
        assert base == pytest.approx(value(row, ()))
        for f in range(2):
            rest = [g for g in range(2) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(1 - len(s)) / 2 * (value(row, (*s, f)) - value(row, s))
                       for k in range(2) for s in itertools.combinations(rest, k))
            assert phi[r, f] == pytest.approx(want)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_contributions_by_pattern(k, monkeypatch):
    rng, leaves = np.random.default_rng(k), []
    for v in rng.random(40):
        bounds = [(-np.inf if rng.random() < 0.3 else low, np.inf if rng.random() < 0.3 else low + 0.5) for low in rng.integers(0, 8, k) / 8]
        leaves.append((v, {int(f): (*b, rng.random()) for f, b in zip(rng.permutation(6)[:k], bounds)}))
    x = rng.integers(0, 9, (500, 6)) / 8  # often a bound itself
    x[::50, 2], x[1::50, 3], x[2::50, 4] = np.nan, np.inf, -np.inf
    want, got, seen, gains = np.zeros_like(x), np.zeros_like(x), [], explain._gains
    explain._row_by_row(leaves, x, want)
    monkeypatch.setattr(explain, "_gains", lambda inside, *a: seen.append(len(inside)) or gains(inside, *a))
    explain._by_pattern(leaves, x, got)
    np.testing.assert_allclose(got, want, atol=1e-12)
    got, base = explain.tree_contributions(leaves, x)
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert seen == [2**k] * 2  # what is worked out hangs on the patterns, not on the rows


def test_batches_are_packed_in_order(blobs):
    cfg = UnsupervisedConfig(columns=COLS, batch_rows=90, sync_batches=3)
    rows, steps = recon.deal_batches(blobs, NAMES, cfg)
    pdf, packed = rows.toPandas(), recon.pack_batches(rows).toPandas()
    assert len(packed) == pdf.batch.nunique() and packed.n.sum() == len(pdf) and packed.step.nunique() == steps
    for r in packed.itertuples():
        mine = pdf[pdf.batch == r.batch]
        x = np.frombuffer(r.data).reshape(-1, 6)
        assert set(mine.step) == {r.step} and (x == recon._ordered(np.stack(mine["__x"]), mine.key.to_numpy())).all()
