from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import alerts, curves, fusion, thresholds
from flowspark.config import AlertConfig

TIES = [(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 1), (0.1, 0)]


@pytest.fixture()
def ties(spark):
    return spark.createDataFrame(TIES, "s double, y int")


def test_pr_points(ties):
    points = {r.threshold: (r.precision, r.recall) for r in curves.pr_curve(ties, "s", "y").collect()}
    assert points == {0.9: (0.5, 1 / 3), 0.5: (0.75, 1.0), 0.1: (0.6, 1.0), None: (1.0, 0.0)}


def test_areas(ties):
    y, s = np.array([t[1] for t in TIES]), np.array([t[0] for t in TIES])
    wins = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert curves.roc_auc(ties, "s", "y").first().auc == pytest.approx(np.mean(wins))
    assert curves.pr_area(ties, "s", "y").first().pr_area == pytest.approx((1 / 3) * (1 + 0.5) / 2 + (2 / 3) * (0.5 + 0.75) / 2)


def test_area_needs_both_classes(ties):
    assert curves.roc_auc(ties.where("y = 1"), "s", "y").first().auc is None


def test_recall_is_one_without_positives(ties):
    assert {r.recall for r in curves.pr_curve(ties.where("y = 0"), "s", "y").where("threshold is not null").collect()} == {1.0}


def test_straight_runs_are_left_out(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)], "s double, y int")
    assert {r.threshold for r in curves.roc_curve(df, "s", "y").collect()} == {None, 0.9, 0.7, 0.5}
    assert curves.roc_curve(df, "s", "y", drop_collinear=False).count() == 6


def test_threshold_ties_take_the_lowest(spark):
    curve = spark.createDataFrame(
        [(0.1, 0.5, 1.0), (0.2, 0.6, 1.0), (0.3, 0.9, 0.5), (0.4, 0.9, 0.5), (None, 1.0, 0.0)], "threshold double, precision double, recall double")
    assert thresholds.curve_thresholds(curve, 0.9, 1.0).first() == (0.3, 0.2, 0.2)
    assert thresholds.curve_thresholds(curve, 0.95, 1.0).first().high_precision == 0.3  # target out of reach


def test_picked_thresholds_reach_their_targets(spark):
    df = spark.range(3000).select((F.rand(1)).alias("u"), F.rand(2).alias("v")).select(
        "u", (F.col("v") < F.col("u")).cast("int").alias("y"))
    bundle = thresholds.as_dict(thresholds.threshold_bundle(df, "u", "y", 0.9, 0.9))
    got = {r.name: r for r in thresholds.evaluate_bundle(df, "u", "y", bundle).collect()}
    assert got["high_precision"].precision >= 0.9 and got["high_recall"].recall >= 0.9
    assert got["best_f1"].f1 >= max(got["high_precision"].f1, got["high_recall"].f1, got["default"].f1)
    assert len({r.auc for r in got.values()}) == 1


def test_calibration_edges_go_down(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0), (1.0, 1), (0.0, 0), (1.7, 1), (0.05, 1)], "s double, y int")
    got = {r.bin: r.n for r in curves.calibration_bins(df, "s", "y").collect()}
    assert got == {0: 3, 1: 1, 9: 2}


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.bin: (r.n, r.density) for r in curves.histogram(df, "v", 12).collect()}
    counts, _ = np.histogram(values, bins=12)
    dens, _ = np.histogram(values, bins=12, density=True)
    assert all(got.get(i, (0, 0))[0] == counts[i] for i in range(12))
    assert all(got.get(i, (0, 0.0))[1] == pytest.approx(dens[i]) for i in range(12))
    assert curves.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).first().n == 3
    assert curves.latency_histogram(df, "v").agg(F.max("bin")).first()[0] == 24


def test_weight_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(int)
    a, b = rng.normal(size=400) + y, rng.normal(size=400) + 0.8 * y
    df = spark.createDataFrame([(float(p), float(q), int(t)) for p, q, t in zip(a, b, y)], "a double, b double, y int")

    def auc(s):
        return np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))

    na, nb = (a - a.min()) / (a.max() - a.min()), (b - b.min()) / (b.max() - b.min())
    grid = fusion.grid_two()
    scores = [auc(w[0] * na + w[1] * nb) for w in grid]
    got = fusion.search_weights(df, ["a", "b"], "y", grid).first()
    assert (got.w1, got.w2) == grid[int(np.argmax(scores))]
    assert got.auc == pytest.approx(max(scores), abs=1e-12)


def test_equal_weights_take_the_first(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)], "a double, y int").withColumn("b", F.col("a"))
    got = fusion.search_weights(df, ["a", "b"], "y", fusion.grid_two()).first()
    assert (got.w1, got.w2, got.auc) == (0.0, 1.0, 1.0)


def test_grid_sizes():
    assert [len(fusion.grid_two()), len(fusion.grid_three()), len(fusion.grid_three_rest())] == [21, 66, 121]


def test_calibration_defaults_on_thin_data(spark):
    df = spark.createDataFrame([(0.3, 0.4, 1), (0.9, 0.8, 0)], "rf_prob double, unsup_score double, y int")
    cfg = alerts.calibrate(df, "y", AlertConfig())
    assert cfg.theta_gray == 0.15 and cfg.theta_unsup_high == 0.5 and cfg.theta_unsup_extreme == 0.85


def test_level_counts_add_up(spark):
    df = spark.range(1000).select(F.rand(3).alias("rf_prob"), F.rand(4).alias("unsup_score"), (F.col("id") % 2).cast("int").alias("y"))
    got = alerts.alert_distribution(alerts.assign_alerts(df), "y").collect()
    assert sum(r["count"] for r in got) == 1000 and len(got) == 4
    only = alerts.alert_distribution(alerts.assign_alerts(df.where("rf_prob < 0.1 and unsup_score < 0.5")), "y").collect()
    assert {r.alert_level: r.attack_ratio for r in only if r.alert_level != "LOW"} == {"MEDIUM": 0.0, "HIGH": 0.0, "CRITICAL": 0.0}


def test_one_scan_sample_and_sketch(spark):
    from flowspark.operators.quantiles import approx_quantiles, sample_exact, sample_small

    df = spark.range(5000).selectExpr("id as sample_id", "cast(pmod(hash(id), 100000) as double) as `a.b`", "cast(null as double) as gone")
    for n in (0, 1, 700, 6000):
        assert sorted(sample_small(df, n).collect()) == sorted(sample_exact(df, n).collect())
    values = sorted(r[1] for r in df.collect())
    for r in approx_quantiles(df, ["a.b", "gone"], [0.0, 0.3, 1.0], 1e-2).collect():
        if r["feature"] == "gone":
            assert r["value"] is None
        else:
            rank = values.index(r["value"])
            assert abs(rank - r["prob"] * 5000) <= 51


def test_bounds_do_not_copy_rows_per_grid_point(spark, monkeypatch):
    """Only points that may win are ranked on copies of the rows; gaps count nowhere."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    rows = [(float(a), float(b), int(k)) for a, b, k in zip(y + 0.4 * rng.normal(size=400), rng.normal(size=400), y)]
    df = spark.createDataFrame([*rows, *[(None, 5.0, 0)] * 50, *[(None, -5.0, 1)] * 50], "a double, b double, y int")
    sizes, expand = [], fusion._expanded
    monkeypatch.setattr(fusion, "_expanded", lambda rows, scaled, grid: sizes.append(len(grid)) or expand(rows, scaled, grid))
    grid = fusion.grid_two()
    got = fusion.search_weights(df, ["a", "b"], "y", grid).first()
    assert len(sizes) == 1 and sizes[0] < len(grid)
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    a, b = (a - a.min()) / (a.max() - a.min()), (b + 5) / 10 if abs(b).max() < 5 else b
    areas = [(s[y == 1][:, None] > s[y == 0]).mean() for s in (w[0] * a + w[1] * b for w in grid)]
    assert got.auc == pytest.approx(max(areas)) and (got.w1, got.w2) == pytest.approx(grid[int(np.argmax(areas))])
