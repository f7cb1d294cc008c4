from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.config import AlertConfig, PrepareConfig, SupervisedConfig
from flowspark.functions import scalars as S


def test_numbers_from_text(spark):
    cells = ["1.5", " 2 ", "1e5", "Infinity", "-inf", "NaN", "abc", "", "1.5f", "1d", "1,000", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(S.finite(S.to_number("t")).alias("v")).collect()]
    assert got == [1.5, 2.0, 1e5] + [None] * 9


def test_timestamps(spark):
    cells = ["2017-07-03 08:55:58", "7/4/2017 9:05", "5/7/2017 8:42:42 AM", "3/7/2017 13:55:58", "x", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(S.to_timestamp("t").alias("v")).collect()]
    assert got == [dt.datetime(2017, 7, 3, 8, 55, 58), dt.datetime(2017, 7, 4, 9, 5), dt.datetime(2017, 5, 7, 8, 42, 42),
                   dt.datetime(2017, 3, 7, 13, 55, 58), None, None]


def test_alert_rule_edges_and_gaps(spark):
    rows = [(0.5, 0.5), (0.5, 0.49), (0.49, 0.0), (0.15, 0.0), (0.14, 0.85), (0.14, 0.84), (None, 0.9), (0.9, None), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, rf double, un double").orderBy("i")
    got = [r[0] for r in df.select(S.alert_code("rf", "un", AlertConfig())).collect()]
    assert got == [3, 2, 1, 1, 1, 0, 1, 2, 0]


def test_binary_label_is_case_sensitive(spark):
    df = spark.createDataFrame([(" BENIGN ",), ("benign",), ("DoS",), (None,), ("  ",)], "l string")
    assert [r[0] for r in df.select(S.binary_label("l")).collect()] == [0, 1, 1, 1, 1]
    assert [r[0] for r in df.select(S.has_label("l")).collect()] == [True, True, True, False, False]


def test_scaling_of_flat_ranges(spark):
    df = spark.createDataFrame([(2.0,), (5.0,)], "s double")
    assert [r[0] for r in df.select(S.min_max("s", 3.0, 3.0)).collect()] == [0.0, 0.0]
    assert [r[0] for r in df.select(S.min_max("s", 3.0, 4.0)).collect()] == [-1.0, 2.0]
    assert [r[0] for r in df.select(S.min_max("s", 3.0, 4.0, clip=True, flat=1e-12)).collect()] == [0.0, 1.0]


def test_rounding_is_half_even(spark):
    xs = [0.1234565, 0.1234575, 2.5e-7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(S.round_even("x", 6)).collect()] == [float(np.round(x, 6)) for x in xs]


def test_ascii_only(spark):
    assert spark.range(1).select(S.ascii_only(F.lit("Web – XSS"))).first()[0] == "Web ? XSS"


@pytest.mark.parametrize("kind, field", [(SupervisedConfig, "precision_target"), (PrepareConfig, "val_ratio")])
def test_settings_outside_the_unit_range(kind, field):
    with pytest.raises(ValueError):
        kind(**{field: 1.5})
