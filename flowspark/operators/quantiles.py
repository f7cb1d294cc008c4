"""Exact order statistics by narrowing value ranges.

Every round is one scan with a small counting aggregate: the range that holds
a wanted rank is cut into equal parts, only the part with the rank survives.
No row is shuffled and no task holds more than the counters, whatever the
number of distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowspark.functions.scalars import finite, hash_order, quoted
from flowspark.staging import local_table

_COUNTERS = 65_536  # counters brought back per round, over all ranges
_FAN = 16  # ranges a value is compared with at a time


@dataclass
class Place:
    """A found order statistic: its value, rows below it, rows equal to it."""

    value: float | int
    below: int
    equal: int


def _located(data: DataFrame, rows: list[tuple], group_type: str, kind: str) -> DataFrame:
    """Values (g, v) that lie in a range, next to it; rows are (g, i, lo, hi, width).

    The ranges of a group do not meet. Where it has many, a value finds its own
    down a tree of ``_FAN`` neighbouring ranges each, not among all of them.
    """
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    levels = [{g: sorted(mine, key=lambda r: r[2]) for g, mine in by.items()}]
    while max(map(len, levels[0].values())) > _FAN:
        levels.insert(0, {g: [(g, None, mine[k][2], mine[min(k + _FAN, len(mine)) - 1][3], None) for k in range(0, len(mine), _FAN)] for g, mine in levels[0].items()})
    data, key, first = data.withColumn("node", F.lit(0)), "g", {g: 0 for g in by}
    for depth, level in enumerate(levels):
        out, numbers = [], {}
        for g, mine in level.items():
            for k, (_, i, lo, hi, width) in enumerate(mine):
                numbers.setdefault(g, len(out))
                up = g if key == "g" else first[g] + k // _FAN
                out.append((up, i, lo, hi, width) if depth + 1 == len(levels) else (up, len(out), lo, hi))
        kinds = f"up {group_type if key == 'g' else 'int'}, i int, lo {kind}, hi {kind}"
        # a local table of exact size, so Spark's own threshold decides on copying it
        ranges = local_table(data.sparkSession, out, kinds + (f", width {kind}" if depth + 1 == len(levels) else ""))
        met = data.join(ranges, data[key] == ranges["up"]).where("v >= lo and v <= hi")
        if depth + 1 == len(levels):
            return met.drop("up", "node", "g")
        data, key, first = met.select("g", "v", F.col("i").alias("node")), "node", numbers


def order_statistics(df: DataFrame, value: str, ranks: dict | Callable[[int], set], group: str) -> tuple[dict, dict]:
    """Value at each wanted 0-based rank.

    ``ranks`` maps group -> ranks (other groups are ignored), or gives the
    ranks for a group of n rows. ``value`` is a double or long column without
    NULLs. Returns {(group, rank): Place} and {group: rows}.
    """
    whole = df.schema[value].dataType.typeName() in ("long", "integer", "bigint")
    kind = "long" if whole else "double"
    data = df.select(F.col(group).alias("g"), F.col(value).cast(kind).alias("v"))
    group_type = df.schema[group].dataType.simpleString()

    found: dict = {}
    open_ranges: dict = {}  # (group, low, high) -> [rows below, wanted ranks]
    edges = data.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    if not callable(ranks) and len(ranks) <= 1000:
        edges = edges.where(F.col("g").isin(list(ranks)))
    sizes = {}
    for row in edges.collect():  # one row per group
        if not callable(ranks) and row.g not in ranks:
            continue
        sizes[row.g] = row.n
        wanted = sorted({min(max(r, 0), row.n - 1) for r in (ranks(row.n) if callable(ranks) else ranks[row.g])})
        if row.lo == row.hi:
            for r in wanted:
                found[row.g, r] = Place(row.lo, 0, row.n)
        else:
            open_ranges[row.g, row.lo, row.hi] = [0, wanted]

    while open_ranges:
        parts = max(2, _COUNTERS // len(open_ranges))
        rows, index = [], {}
        for i, (g, lo, hi) in enumerate(open_ranges):
            width = (hi - lo) // parts + 1 if whole else max((hi / 2 - lo / 2) / parts, 5e-324)
            rows.append((g, i, lo, hi, width))
            index[i] = (g, lo, hi)
        if whole:
            part = F.expr("least((v - lo) div width, %d)" % (parts - 1))
        else:
            part = F.expr("least(cast(floor((v / 2 - lo / 2) / width) as long), %d)" % (parts - 1))
        # one row per open range, at most two per wanted rank
        counted = (
            _located(data, rows, group_type, kind)
            .groupBy("i", part.alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        per_range: dict = {}
        for row in counted.collect():  # bounded by ranges x parts
            per_range.setdefault(row.i, []).append(row)
        following: dict = {}
        for i, key in index.items():
            below, wanted = open_ranges[key]
            pending = list(wanted)
            for row in sorted(per_range.get(i, []), key=lambda r: r.part):
                here = [r for r in pending if below <= r < below + row.n]
                if here:
                    pending = [r for r in pending if r not in here]
                    if row.lo == row.hi:
                        for r in here:
                            found[key[0], r] = Place(row.lo, below, row.n)
                    else:
                        following[key[0], row.lo, row.hi] = [below, here]
                below += row.n
        open_ranges = following
    return found, sizes


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """Linear-interpolation quantiles of finite values: {(column, prob): value or None}."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("g"), finite(F.col(quoted(c)).cast("double")).alias("v")) for c in columns]
    )
    long = df.select(F.explode(entries).alias("e")).select("e.g", "e.v").where("v is not null")

    def wanted(n: int) -> set:
        lows = {math.floor(p * (n - 1)) for p in probs}
        return lows | {low + 1 for low in lows}

    found, sizes = order_statistics(long, "v", wanted, "g")
    out = {}
    for c in columns:
        for p in probs:
            if c not in sizes:
                out[c, p] = None
                continue
            spot = p * (sizes[c] - 1)
            low = math.floor(spot)
            a = found[c, low].value
            b = found[c, min(low + 1, sizes[c] - 1)].value
            out[c, p] = a + (b - a) * (spot - low)
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per column and probability."""
    found = exact_quantiles(df, columns, probs)
    rows = [(c, float(p), v) for (c, p), v in found.items()]
    return local_table(df.sparkSession, rows, "feature string, prob double, value double")


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], rank_error: float = 1e-4) -> DataFrame:
    """(feature, prob, value): a value of the column whose rank among its n
    finite values is off by ``rank_error`` * n at most. One scan for all
    columns, whose sketches are merged; null for a column without values."""
    sketches = [F.percentile_approx(finite(F.col(quoted(c)).cast("double")), list(probs), round(1 / rank_error)).alias(f"q{i}") for i, c in enumerate(columns)]
    one = df.agg(*sketches)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(p)).alias("prob"), F.get(f"q{i}", F.lit(j)).alias("value"))
                      for i, c in enumerate(columns) for j, p in enumerate(probs)])
    return one.select(F.inline(cells))


def hash_cutoffs(df: DataFrame, sample_id: str, group: str, takes: dict, seed: int) -> dict:
    """Cut keys so that exactly ``k`` rows of a group lie at or below each.

    ``takes`` maps group -> counts. Rows are ordered by (hash, id). Returns
    {(group, k): (hash, id)} with (-1, -1) for k = 0.
    """
    keyed = df.select(group, F.col(quoted(sample_id)).cast("long").alias("__id"),
                      hash_order(sample_id, seed).alias("__h"))
    ranks = {g: {k - 1 for k in ks if k > 0} for g, ks in takes.items()}
    found, _ = order_statistics(keyed, "__h", {g: r for g, r in ranks.items() if r}, group)
    cuts = {}
    for g, ks in takes.items():
        for k in ks:
            if k <= 0:
                cuts[g, k] = (-1, -1)
                continue
            place = found[g, k - 1]
            if place.below + place.equal == k:
                cuts[g, k] = (place.value, 2**63 - 1)
                continue
            # several ids share the cut hash: settle among them by id
            tied = keyed.where((F.col(group) == F.lit(g)) & (F.col("__h") == F.lit(place.value)))
            rank = k - 1 - place.below
            cuts[g, k] = (place.value, order_statistics(tied, "__id", {g: {rank}}, group)[0][g, rank].value)
    return cuts


def within_cut(sample_id: str, seed: int, cut_hash: Column, cut_id: Column) -> Column:
    """Rows whose (hash, id) lies at or below the cut; one comparison, one hash."""
    key = F.struct(hash_order(sample_id, seed).alias("h"), F.col(quoted(sample_id)).cast("long").alias("i"))
    return key <= F.struct(cut_hash.cast("long").alias("h"), cut_id.cast("long").alias("i"))


def sample_exact(df: DataFrame, n: int, sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """Uniform sample of min(n, rows) rows without replacement, seeded by id."""
    total = df.count()
    if n >= total:
        return df
    tagged = df.withColumn("__all", F.lit(1))
    cut = hash_cutoffs(tagged, sample_id, "__all", {1: [n]}, seed)[1, n]
    return df.where(within_cut(sample_id, seed, F.lit(cut[0]), F.lit(cut[1])))


def sample_small(df: DataFrame, n: int, sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """The rows of ``sample_exact`` in one scan, for n rows that fit a task:
    every task keeps its n smallest keys, and those meet."""
    return df.orderBy(hash_order(sample_id, seed), F.col(quoted(sample_id)).cast("long")).limit(n)


__all__ = [
    "Place", "approx_quantiles", "exact_quantiles", "hash_cutoffs", "order_statistics", "quantile_table",
    "sample_exact", "sample_small", "within_cut",
]
