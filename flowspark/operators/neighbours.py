"""Nearest-neighbour mutual information of features with the class.

The estimate compares, for every row, the distance to its k-th neighbour of the
same class with the number of rows of any class nearer than that. Both are
questions about one sorted column, so each feature is range-sorted once and cut
into cells of bounded size. Neighbours beyond a cell's edges come as a halo: the
first and last k values of each class in the cells around it. Rows nearer than
the radius are counted inside the cell; a radius that reaches beyond it becomes
two rank questions, answered by the cell in which the end falls and the rows of
all cells before. At most about 2k rows per class and cell reach beyond.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.functions.scalars import quoted
from flowspark.operators.ordering import running_sums
from flowspark.staging import ship_package, staged

CELL = 1 << 16  # values of a feature in a cell
NOISE = 1e-10  # of the larger of deviation and mean size, to part equal values


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers from 1: upwards to 16, then the asymptotic series."""
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    for _ in range(16):
        low = n < 16
        out -= np.where(low, 1 / n, 0)
        n = np.where(low, n + 1, n)
    s = 1 / (n * n)
    return out + np.log(n) - 0.5 / n - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))


def _uniform(sample_id: Column, feature: Column) -> Column:
    """A number in [-1, 1) from the digest of row and feature."""
    digits = F.substring(F.md5(F.concat_ws(":", sample_id.cast("string"), feature).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 51) - 1.0


def class_values(df: DataFrame, features: Sequence[str], label: str, sample_id: str, noise: float = NOISE) -> DataFrame:
    """(feature, y, x, same) of every finite value, equal values parted by a
    noise that hangs on row and feature only; ``same`` is the number of the
    feature's rows of that class, two at least."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(quoted(c)).cast("double").alias("x")) for c in features])
    long = df.select(F.col(quoted(sample_id)).alias("id"), F.col(quoted(label)).cast("int").alias("y"), F.explode(cells).alias("e")).select("id", "y", "e.*")
    long = long.where(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    sizes = long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("same")).where("same > 1")
    spread = long.groupBy("feature").agg((F.greatest(F.stddev_pop("x"), F.avg(F.abs("x"))) * F.lit(noise)).alias("step"))
    both = staged(sizes.join(spread, "feature"), "classes")  # a row per feature and class
    return long.join(both, ["feature", "y"]).select("feature", "y", (F.col("x") + _uniform(F.col("id"), F.col("feature")) * F.col("step")).alias("x"), "same")


_CELL_FIELDS = [("feature", pa.string()), ("task", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("xs", pa.binary()), ("ys", pa.binary()),
                ("edges", pa.list_(pa.struct([("y", pa.int32()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))])))]
_CELLS = "feature string, task long, seq long, n long, low double, xs binary, ys binary, edges array<struct<y:int,head:array<double>,tail:array<double>>>"


def sorted_cells(values: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """One row per cell of a feature's sorted values: values and classes as
    bytes, and the first and last k values of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, name, xs, ys = TaskContext.get().partitionId(), 0, None, [], []

        def cells(last: bool):
            nonlocal seq, xs, ys
            x, y = np.concatenate(xs), np.concatenate(ys)
            full = len(x) if last else len(x) // cell * cell
            for i in range(0, full, cell):
                a, c = x[i : min(i + cell, full)], y[i : min(i + cell, full)]
                edges = [{"y": int(v), "head": a[c == v][:k].tolist(), "tail": a[c == v][-k:].tolist()} for v in np.unique(c)]
                row = (name, task, seq, len(a), float(a[0]), a.tobytes(), c.tobytes(), edges)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _CELL_FIELDS, strict=True)], names=[f for f, _ in _CELL_FIELDS])
                seq += 1
            xs, ys = [x[full:]], [y[full:]]

        for batch in batches:
            names, x, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if name != names[i]:
                    if xs:
                        yield from cells(True)
                    name, xs, ys = names[i], [], []
                xs.append(x[i:j])
                ys.append(y[i:j])
                if sum(map(len, xs)) >= 2 * cell:
                    yield from cells(False)
        if xs and sum(map(len, xs)):
            yield from cells(True)

    rows = values.select("feature", "x", "y").repartitionByRange("feature", "x").sortWithinPartitions("feature", "x")
    return rows.mapInArrow(run, _CELLS)


def _halos(cells: DataFrame, k: int) -> DataFrame:
    """(feature, task, seq, halo): for each class of a cell the k values before
    and after it. A cell that has a class has one value of it at least, so k
    cells on either side are enough."""
    edges = cells.select("feature", "task", "seq", F.explode("edges").alias("e")).select("feature", "task", "seq", "e.*")
    order = W.partitionBy("feature", "y").orderBy("task", "seq")
    before = F.flatten(F.collect_list("tail").over(order.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("head").over(order.rowsBetween(1, k)))
    near = edges.select("feature", "task", "seq", "y", F.slice(before, F.greatest(F.size(before) - k + 1, F.lit(1)), k).alias("before"), F.slice(after, 1, k).alias("after"))
    return near.groupBy("feature", "task", "seq").agg(F.collect_list(F.struct("y", "before", "after")).alias("halo"))


def radii(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values ``x`` to its k-th neighbour, with
    the values around them."""
    whole = np.concatenate((before, x, after))
    k = min(k, len(whole) - 1)
    place = np.arange(len(before), len(before) + len(x))
    near = np.full((len(x), 2 * k), np.inf)
    for j in range(1, k + 1):
        low, high = place - j, place + j
        near[:, 2 * j - 2] = np.where(low >= 0, x - whole[np.maximum(low, 0)], np.inf)
        near[:, 2 * j - 1] = np.where(high < len(whole), whole[np.minimum(high, len(whole) - 1)] - x, np.inf)
    return np.partition(near, k - 1, axis=1)[:, k - 1]


def _outside(distance: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether a row at this distance is not counted: nearer ones are, and equal values where the radius is zero."""
    return np.where(r > 0, distance >= r, distance > 0)


def _inside(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past last place in the sorted cell ``x`` of the rows that
    count for each value. The rounded ends are put right by the distances, value
    by value."""
    n = len(x)
    lo, hi = np.searchsorted(x, x - r, "left"), np.searchsorted(x, x + r, "right")
    moves = [
        (lo, lambda i: (i < n) & _outside(x - x[np.minimum(i, n - 1)], r), lambda i: np.searchsorted(x, x[i], "right")),
        (lo, lambda i: (i > 0) & ~_outside(x - x[np.maximum(i - 1, 0)], r), lambda i: np.searchsorted(x, x[i - 1], "left")),
        (hi, lambda i: (i > 0) & _outside(x[np.maximum(i - 1, 0)] - x, r), lambda i: np.searchsorted(x, x[i - 1], "left")),
        (hi, lambda i: (i < n) & ~_outside(x[np.minimum(i, n - 1)] - x, r), lambda i: np.searchsorted(x, x[i], "right"))]
    for place, wrong, moved in moves:
        while (bad := wrong(place)).any():
            place[bad] = moved(place[bad])
    return lo, hi


def _ordered(v: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; its own inverse on bits."""
    i = v.view(np.int64)
    return i ^ ((i >> 63) & np.int64((1 << 63) - 1))


def _ends(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value below and the smallest above each ``x`` that no longer
    count, exact to the last bit by bisection."""
    out = []
    for sign in (1, -1):
        y = sign * x
        far = _ordered(np.minimum(y - 2 * r, np.nextafter(y, -np.inf)))
        near = _ordered(y + 0.0)
        while (near > far + 1).any():
            middle = (far & near) + ((far ^ near) >> 1)  # their mean, without the sum
            gone = _outside(y - _double(middle), r)
            far, near = np.where(gone, middle, far), np.where(gone, near, middle)
        out.append(sign * _double(far))
    return out[0], out[1]


def _double(i: np.ndarray) -> np.ndarray:
    return (i ^ ((i >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def _counted(cells: DataFrame, k: int) -> DataFrame:
    """Per cell the digamma sum of rows that end inside it, and the others:
    (feature, total, open: the nearest values that do not count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, xs, ys, first, last, halo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y, r = np.frombuffer(xs), np.frombuffer(ys, np.int32), np.empty(n)
                for h in halo:
                    mine = y == h["y"]
                    r[mine] = radii(x[mine], np.array(h["before"], float), np.array(h["after"], float), k)
                lo, hi = _inside(x, r)
                closed = (first | _outside(x - x[0], r)) & (last | _outside(x[-1] - x, r))
                low, high = _ends(x[~closed], r[~closed])
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([float(digamma((hi - lo)[closed]).sum())]),
                    pa.array([[{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)]], pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())])))],
                    names=["feature", "total", "open"])

    place = W.partitionBy("feature").orderBy("task", "seq")  # a row per cell, without its values
    keys = ["feature", "task", "seq"]
    outer = cells.select(*keys).withColumn("first", F.row_number().over(place) == 1).withColumn("last", F.lead("seq").over(place).isNull())
    rows = cells.drop("edges").join(outer, keys).join(_halos(cells, k), keys)
    return rows.select("feature", "n", "xs", "ys", "first", "last", "halo").mapInArrow(run, "feature string, total double, open array<struct<low:double,high:double>>")


def _ranks(cells: DataFrame, ends: DataFrame) -> DataFrame:
    """(feature, row, rows): for each open row the number of the feature's
    values between its ends. An end is a question to the last cell that begins
    before it: how many values lie below (or up to) it."""
    low = F.struct(F.col("low").alias("value"), F.lit(2).alias("kind"), F.lit(-1).alias("sign"))
    high = F.struct(F.col("high").alias("value"), F.lit(0).alias("kind"), F.lit(1).alias("sign"))
    asked = ends.select("feature", "row", F.explode(F.array(low, high)).alias("e")).select("feature", "row", "e.*", F.lit(0).cast("long").alias("starts"), F.lit(0).cast("long").alias("n"))
    # kinds in order: values below an end, where a cell begins, values up to an end
    starts = cells.select("feature", F.lit(-1).cast("long").alias("row"), F.col("low").alias("value"), F.lit(1).alias("kind"), F.lit(0).alias("sign"), F.lit(1).cast("long").alias("starts"), "n", "task", "seq")
    events = asked.withColumns({"task": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long")}).unionByName(starts)
    placed = staged(running_sums(events, [F.col(c) for c in ("value", "kind", "task", "seq", "row")], {"cell": "starts", "upto": "n"}, ["feature"]), "placed")
    numbers = placed.where("kind = 1").select("feature", "task", "seq", "cell", (F.col("upto") - F.col("n")).alias("before"))
    blobs = cells.select("feature", "task", "seq", "xs").join(numbers, ["feature", "task", "seq"]).select("feature", "cell", "before", "xs")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        row, sign = right["asked_row"].to_numpy(), right["asked_sign"].to_numpy().astype(np.int64)
        if not len(left) or not len(right):  # nothing asked, or an end before all cells
            return pa.table({"feature": pa.array([], pa.string()), "row": pa.array([], pa.int64()), "rows": pa.array([], pa.int64())})
        x, v, upto = np.frombuffer(left["xs"][0].as_py()), right["asked_value"].to_numpy(), right["asked_kind"].to_numpy() == 2
        rank = np.where(upto, np.searchsorted(x, v, "right"), np.searchsorted(x, v, "left")) + left["before"][0].as_py()
        return pa.table({"feature": right["asked_feature"], "row": pa.array(row), "rows": pa.array(sign * rank)})

    asked = placed.where("kind <> 1").select(*[F.col(c).alias("asked_" + c) for c in ("feature", "cell", "row", "value", "kind", "sign")])
    found = blobs.groupBy("feature", "cell").cogroup(asked.groupBy("asked_feature", "asked_cell")).applyInArrow(count, "feature string, row long, rows long")
    return found.groupBy("feature", "row").agg(F.sum("rows").alias("rows"))


def mi_knn(df: DataFrame, features: Sequence[str], label: str, sample_id: str = "sample_id", k: int = 3, noise: float = NOISE, cell: int = CELL) -> DataFrame:
    """(feature, mi): information in nats between each feature and the class by
    the ``k`` nearest neighbours in the class, over all rows.

    Values that are null or not finite do not count for their feature, nor do
    rows without a class and classes of one row; a class of fewer rows than k
    asks for those it has. Equal values are parted by a noise of ``noise`` times
    the larger of deviation and mean size that hangs on row id and feature. A
    feature without rows has no result. The result does not hang on partitions
    but for the order in which doubles are added.
    """
    spark = df.sparkSession
    ship_package(spark)
    values = class_values(df, features, label, sample_id, noise)
    cells = staged(sorted_cells(values, k, cell), "cells")
    counted = staged(_counted(cells, k), "counted")
    ends = counted.select("feature", F.explode("open").alias("e")).select("feature", "e.*").withColumn("row", F.monotonically_increasing_id())
    ranks = _ranks(cells, staged(ends, "ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digamma(np.maximum(batch.column(1).to_numpy(), 1)))], names=["feature", "total"])

    near = counted.select("feature", "total").union(ranks.select("feature", "rows").mapInArrow(run, "feature string, total double"))
    near = near.groupBy("feature").agg(F.sum("total").alias("near"))
    classes = values.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("same"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n * (digamma(np.minimum(k, n - 1)) - digamma(n)))], names=["feature", "same", "term"])

    own = classes.select("feature", "same").mapInArrow(terms, "feature string, same long, term double")
    own = own.groupBy("feature").agg(F.sum("same").alias("rows"), F.sum("term").alias("own"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own_, near_ = (batch.column(i).to_numpy() for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(digamma(n) + (own_ - near_) / n, 0))], names=["feature", "mi"])

    return own.join(near, "feature").select("feature", "rows", "own", "near").mapInArrow(final, "feature string, mi double")
