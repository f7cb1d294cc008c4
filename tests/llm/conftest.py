from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Null in every column, empty and blank texts, ties, repeated rows, a clashing extra column and one with a dot.
AWKWARD = [
    (1, "The cat sat on the mat and the dog sat on the log", "a", 1, "x"),
    (2, "The cat sat on the mat and the dog sat on the log", "a", 1, "x"),
    (2, "The cat sat on the mat and the dog sat on the log", "a", 1, "x"),
    (3, "", "b", 2, "x"),
    (4, None, "b", 2, None),
    (None, "no id here\n\nSAME LINE \nanother", None, 3, "x"),
    (5, "  \t\n ", None, None, "x"),
    (6, "Ünï ▁cödé 𝔘 \x00 ​ emoji 😀", "c", 4, "x"),
    (7, "word " * 3000, "a", 5, "x"),
    (8, "tail", "a", 6, "x"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("row", T.LongType()), T.StructField("score.x", T.StringType())])


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
