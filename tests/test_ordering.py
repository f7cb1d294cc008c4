from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from flowspark.functions.scalars import hash_order
from flowspark.operators import ordering, quantiles as qu


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_equal_one_window(spark, parts):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), (F.col("id") % 11).alias("x")).repartition(parts)
    got = ordering.running_sums(df, [F.col("o").desc()], {"s": "x"}, ["k"])
    want = df.withColumn("s", F.sum("x").over(W.partitionBy("k").orderBy(F.col("o").desc())))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("parts", [1, 7])
def test_row_numbers_and_next(spark, parts):
    df = spark.range(2000).select(F.xxhash64("id").alias("o")).repartition(parts)
    got = [r.n for r in ordering.row_numbers(df, [F.col("o").asc()], "n", start=1).orderBy("o").collect()]
    assert got == list(range(1, 2001))
    pairs = ordering.with_next(df, [F.col("o").asc()], ["o"]).orderBy("o").collect()
    assert [p.next_o for p in pairs] == [p.o for p in pairs[1:]] + [None]


def test_order_with_one_dominant_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("v"), "id")
    got = [r.n for r in ordering.row_numbers(df, [F.col("v").asc(), F.col("id").asc()], "n").orderBy("v", "id").collect()]
    assert got == list(range(5000))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    columns = {
        "normal": rng.normal(size=4000), "heavy": np.exp(rng.normal(size=4000) * 8), "ties": rng.integers(0, 3, 4000).astype(float),
        "hot": np.where(np.arange(4000) < 2900, 5.0, rng.normal(size=4000)), "tiny": rng.normal(size=4000) * 1e-300,
        "wide": np.where(rng.random(4000) < 0.5, -1.5e308, 1.5e308) * rng.random(4000), "flat": np.full(4000, 2.0)}
    rows = [tuple(float(c[i]) for c in columns.values()) for i in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.99, 0.995, 1.0]
    found = qu.exact_quantiles(df, list(columns), probs)
    for c, values in columns.items():
        if c == "wide":
            order = np.sort(values)
            assert found[c, 0.0] == order[0] and found[c, 1.0] == order[-1]
            continue
        np.testing.assert_allclose([found[c, p] for p in probs], np.quantile(values, probs), rtol=1e-12)


def test_quantiles_leave_out_gaps(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (float("inf"), None)], "a double, b double")
    assert qu.exact_quantiles(df, ["a", "b"], [0.5]) == {("a", 0.5): 2.0, ("b", 0.5): None}


def test_sample_is_exact_and_order_free(spark):
    df = spark.range(5000).withColumnRenamed("id", "sample_id")
    one = {r[0] for r in qu.sample_exact(df.repartition(3), 321).collect()}
    two = {r[0] for r in qu.sample_exact(df.coalesce(1), 321).collect()}
    want = [r[0] for r in df.orderBy(hash_order("sample_id", 42), "sample_id").limit(321).collect()]
    assert one == two == set(want)
    assert qu.sample_exact(df, 9999).count() == 5000


def test_cut_between_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(qu, "hash_order", lambda c, seed, salt="": (F.col(c.strip("`")) % 2).cast("long"))
    df = spark.range(20).withColumnRenamed("id", "sample_id")
    got = sorted(r[0] for r in qu.sample_exact(df, 13).collect())
    assert got == sorted([*range(0, 20, 2), 1, 3, 5])


def test_a_value_is_compared_with_few_ranges(spark, monkeypatch):
    rng, fans, local = np.random.default_rng(3), [], qu.local_table
    x = np.stack([rng.normal(size=5000), rng.normal(size=5000) * 1e-3, rng.integers(0, 40, 5000)], 1)
    x[7, 1] = 1e9  # all others fall into one part of the first ranges
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))

    def noted(session, rows, schema):
        fans.append(max(Counter(r[0] for r in rows).values()))
        return local(session, rows, schema)

    monkeypatch.setattr(qu, "local_table", noted)
    probs = [i / 256 for i in range(1, 256)]
    got = qu.exact_quantiles(df, ["a", "b", "c"], probs)
    for i, c in enumerate("abc"):
        np.testing.assert_allclose([got[c, p] for p in probs], np.quantile(x[:, i], probs), rtol=1e-12)
    assert 1 < max(fans) <= 16
