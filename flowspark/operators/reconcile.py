"""Comparing generated flow tables with labelled reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowspark.functions.scalars import quoted
from flowspark.functions.headers import LABELLED_TO_GENERATED


class ColumnsMissing(ValueError):
    """A table lacks the columns matching needs."""


FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def to_generated_names(df: DataFrame) -> DataFrame:
    """Rename labelled headers to the generated layout."""
    return df.withColumnsRenamed({k: v for k, v in LABELLED_TO_GENERATED.items() if k in df.columns})


def schema_difference(generated: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mapped pairs, labelled columns without counterpart, and extra columns."""
    have = set(generated.columns)
    rows = []
    for c in labelled.columns:
        if c in ("Flow ID", "Label"):
            continue
        other = LABELLED_TO_GENERATED.get(c)
        if other is None:
            rows.append(("unmapped", c, None))
        else:
            rows.append(("mapped" if other in have else "absent", c, other))
    known = set(LABELLED_TO_GENERATED.values())
    rows += [("extra", None, c) for c in generated.columns if c not in known]
    return generated.sparkSession.createDataFrame(rows, "status string, labelled string, generated string")


def flow_id_variants(src: str, dst: str, sport: str, dport: str, proto: str) -> Column:
    """The four spellings of a flow id, in the order they are tried; null when a
    part is missing, as such a row has no id."""
    a, b = F.col(quoted(src)).cast("string"), F.col(quoted(dst)).cast("string")
    x, y = F.col(quoted(sport)).cast("int").cast("string"), F.col(quoted(dport)).cast("int").cast("string")
    p = F.col(quoted(proto)).cast("int").cast("string")
    orders = ((b, a, y, x), (b, a, x, y), (a, b, x, y), (a, b, y, x))
    return F.array_distinct(F.array(*[F.concat(*[x for part in o for x in (part, F.lit("-"))], p) for o in orders]))


def first_labels(labelled: DataFrame, row_id: str = "sample_id", flow_id: str = "Flow ID", label: str = "Label") -> DataFrame:
    """Label of the first row, in file order, of every flow id."""
    lab = F.trim(F.col(quoted(label))) if label in labelled.columns else F.lit(None).cast("string")
    return labelled.groupBy(F.trim(F.col(quoted(flow_id))).alias("flow_id")).agg(F.min_by(lab, F.col(quoted(row_id))).alias("label"))


def _parts_key(flow_id: Column) -> Column:
    """The same for all spellings of a flow id: they differ in the order of their parts only."""
    return F.xxhash64(F.array_join(F.array_sort(F.split(flow_id, "-")), "-"))


def match_flows(generated: DataFrame, labelled: DataFrame, row_id: str = "sample_id") -> DataFrame:
    """Distinct generated 5-tuples with row count, matched flow id and label.

    Rows are folded to distinct 5-tuples first, so a flow id that dominates
    the table is one row in the join. All spellings of a 5-tuple share a key,
    so it moves once, not once per spelling; the spelling is compared where
    both sides meet, and the first one found is picked there too.
    """
    if "Flow ID" not in labelled.columns:
        raise ColumnsMissing("the labelled table has no Flow ID")
    if not set(FIVE_TUPLE) <= set(generated.columns):
        raise ColumnsMissing("the generated table lacks the 5-tuple")
    tuples = generated.groupBy(*FIVE_TUPLE).agg(F.count(F.lit(1)).alias("n_rows"))
    first = F.get("spellings", F.lit(0))  # null when a part is missing: such rows match none and need not meet
    tuples = tuples.withColumn("spellings", flow_id_variants(*FIVE_TUPLE))
    tuples = tuples.select(*FIVE_TUPLE, "n_rows", F.when(first.isNotNull(), _parts_key(first)).otherwise(F.xxhash64(*FIVE_TUPLE)).alias("key"))
    known = first_labels(labelled, row_id).where("flow_id is not null").select(_parts_key(F.col("flow_id")).alias("known_key"), "flow_id", "label")
    place = F.array_position(flow_id_variants(*FIVE_TUPLE), F.col("flow_id"))
    hits = tuples.join(known, (F.col("key") == F.col("known_key")) & (place > 0), "left")
    found = F.when(F.col("flow_id").isNotNull(), place)
    # grouped by the join's key as well, so rows stay where they are
    return hits.groupBy("key", *FIVE_TUPLE).agg(
        F.first("n_rows").alias("n_rows"), F.min_by("flow_id", found).alias("flow_id"), F.min_by("label", found).alias("label")).drop("key")


def match_summary(matches: DataFrame) -> DataFrame:
    """Rows, hits and hit rate."""
    hit = F.when(F.col("flow_id").isNotNull(), F.col("n_rows")).otherwise(0)
    return matches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_matched")).withColumn(
        "hit_rate", F.col("n_matched") / F.greatest(F.col("n_rows"), F.lit(1)))


def matched_labels(matches: DataFrame) -> DataFrame:
    """Matched rows per label."""
    return matches.where("flow_id is not null and label is not null").groupBy("label").agg(F.sum("n_rows").alias("n"))


def first_rows(df: DataFrame, n: int, row_id: str = "sample_id") -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(quoted(row_id)).limit(n)
