from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowspark.config import FlowColumns, PrepareConfig
from flowspark.operators import split as sp

CFG = PrepareConfig(columns=FlowColumns(label="label"))


def test_rest_of_one_hundred_splits_49_51():
    assert sp.split_quotas({"a": 333}) == {"a": (233, 49, 51)}
    assert sp.split_quotas({"a": 100}) == {"a": (70, 14, 16)}


def test_shares_stay_within_one_row():
    counts = {"a": 1000, "b": 37, "c": 5, "d": 2}
    quotas = sp.split_quotas(counts)
    assert all(sum(quotas[c]) == n for c, n in counts.items())
    assert all(abs(quotas[c][0] - 730 * n / 1044) < 1 for c, n in counts.items())
    assert sum(q[0] for q in quotas.values()) == 730


def test_single_row_class_trains():
    with pytest.warns(UserWarning, match="single row"):
        assert sp.split_quotas({"a": 10, "b": 1})["b"] == (1, 0, 0)


def test_split_is_a_partition_whatever_the_layout(spark):
    df = spark.range(4000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("label"))
    one = sp.stratified_split(df.repartition(7), "label", "s", CFG)
    two = sp.stratified_split(df.coalesce(1), "label", "s", CFG)
    assert one.count() == 4000 and one.exceptAll(two).isEmpty()
    counts = {(r.label, r.s): r.n for r in sp.label_counts(one, "s", "label").collect()}
    assert counts["rare", "train"] == 56 and counts["hot", "train"] == 2744
    assert sum(n for (_, s), n in counts.items() if s == "val") in (599, 600)
