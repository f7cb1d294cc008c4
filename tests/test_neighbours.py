"""Nearest-neighbour information against a plain numpy version."""

from __future__ import annotations

import numpy as np
import pytest

from flowspark.operators import neighbours as N


def plain(values, k=3):
    out = {}
    for feature, g in values.groupby("feature"):
        x, y = g.x.to_numpy(), g.y.to_numpy()
        r, near, own = (np.empty(len(x)) for _ in range(3))
        for c in np.unique(y):
            a = x[y == c]
            near[y == c], own[y == c] = min(k, len(a) - 1), len(a)
            r[y == c] = np.sort(np.abs(a[:, None] - a[None, :]), 1)[:, min(k, len(a) - 1)]
        gaps = np.abs(x[:, None] - x[None, :])
        inside = (gaps < r[:, None]) | ((r == 0)[:, None] & (gaps == 0))
        out[feature] = max(0.0, float(N.digamma(len(x)) + N.digamma(near).mean() - N.digamma(own).mean() - N.digamma(inside.sum(1)).mean()))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.3)
        rows.append((i, y if i % 50 else 7 if i % 100 else None, float(rng.normal() + 2 * y), float(rng.integers(0, 4)), float("nan") if i % 9 == 0 else None if i % 7 == 0 else float(rng.exponential()), 5.0, float(i)))
    rows[5] = (5, 99, *rows[5][2:])  # a class of one row
    return spark.createDataFrame(rows, "sample_id long, label int, `a.b` double, ties double, gaps double, flat double, x double")


NAMES = ["a.b", "ties", "gaps", "flat", "x"]


@pytest.mark.parametrize("cell", [N.CELL, 23, 1])
def test_same_as_plain(table, cell):
    if cell == 1:
        table = table.where("sample_id < 60")
    want = plain(N.class_values(table, NAMES, "label", "sample_id").toPandas())
    got = {r["feature"]: r["mi"] for r in N.mi_knn(table.repartition(5), NAMES, "label", cell=cell).collect()}
    assert got == pytest.approx(want, abs=1e-9) and set(got) == set(NAMES)
    if cell > 1:
        assert got["a.b"] > 0.2 > got["flat"]


def test_equal_values_without_noise(table):
    want = plain(N.class_values(table, ["ties", "flat"], "label", "sample_id", 0.0).toPandas())
    got = {r["feature"]: r["mi"] for r in N.mi_knn(table, ["ties", "flat"], "label", noise=0.0, cell=31).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_nothing(spark, table):
    assert N.mi_knn(table.where("false"), NAMES, "label").count() == 0
    assert N.mi_knn(table.select("sample_id", "label", "x").withColumn("x", table.x * float("nan")), ["x"], "label").count() == 0


def test_digamma():
    n = np.arange(1, 5000)
    harmonic = np.concatenate(([0], np.cumsum(1 / n)))[: len(n)] - np.euler_gamma
    np.testing.assert_allclose(N.digamma(n), harmonic, atol=1e-12)


def test_radii():
    x, before, after = np.array([1.0, 2.0, 4.0]), np.array([0.5]), np.array([4.5, 9.0])
    assert N.radii(x, before, after, 2).tolist() == [1.0, 1.5, 2.0]


def test_ends_are_exact():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=50), [0.0, 1e300, -1e-300, 5e-324, 3.0]))
    r = np.abs(np.concatenate((rng.normal(size=50) * 10.0 ** rng.integers(-15, 3, 50), [1.0, 1e299, 1e-300, 0.0, 0.0])))
    low, high = N._ends(x, r)
    assert N._outside(x - low, r).all() and not N._outside(x - np.nextafter(low, np.inf), r).any()
    assert N._outside(high - x, r).all() and not N._outside(np.nextafter(high, -np.inf) - x, r).any()
