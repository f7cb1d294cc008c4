"""Feature contributions of a fitted forest (path-dependent Shapley values).

Trees and rows are both dealt out: trees in blocks of bounded size, rows in
shares, and each task streams a share of the rows past a block of trees. What a
task finds per row is summed over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowspark.functions.scalars import quoted
from flowspark.operators.clean import impute_own
from flowspark.operators.quantiles import sample_exact
from flowspark.operators.trees import TreeModel, features_of, matrix
from flowspark.staging import ship_package, staged

NODES_PER_BLOCK = 100_000  # tree nodes that one task explains at a time, one tree at least
_CELLS = 1 << 21  # rows x leaves x features held at a time
_ROWS = 256
_LOOKUPS = 1 << 16  # rows x leaves looked up at a time


def _paths(tree: dict[str, np.ndarray]) -> list[tuple[float, dict]]:
    """Leaves as (value, {feature: (low, high, share of training weight)})."""
    at = {n: i for i, n in enumerate(tree["node"].tolist())}
    feature, cut, left, right, cover, value = (tree[c].tolist() for c in ("feature", "cut", "left", "right", "cover", "value"))
    leaves, waiting = [], [(0, {})]
    while waiting:
        node, path = waiting.pop()
        i = at[node]
        f = feature[i]
        if f < 0:
            leaves.append((value[i], path))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left[i], (low, min(high, cut[i]))), (right[i], (max(low, cut[i]), high))):
            part = cover[at[child]] / cover[i] if cover[i] > 0 else 0.0
            waiting.append((child, {**path, f: (*bounds, share * part)}))
    return leaves


def _weights(k: int) -> np.ndarray:
    """Shapley weight of a coalition of each size among k players."""
    out = np.empty(k)
    out[0] = 1.0 / k
    for s in range(1, k):
        out[s] = out[s - 1] * s / (k - s)
    return out


def _gains(inside: np.ndarray, share: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    """[row, leaf] for each of the k features that all leaves have: what knowing
    it adds to the leaf's value. ``inside`` is [row, leaf, feature].

    A leaf is a product over its features: inside the bounds or the share of
    training weight. The product is extended feature by feature as a polynomial
    in the coalition's size; each feature's own factor is then unwound from it.
    """
    k = share.shape[1]
    weights = _weights(k)
    poly = np.zeros((*inside.shape[:2], k + 1))
    poly[..., 0] = 1.0
    for m in range(k):
        grown = poly * share[:, m, None]
        grown[..., 1:] += poly[..., :-1] * inside[..., m, None]
        poly = grown
    for j in range(k):
        s, met = share[:, j], inside[..., j]
        rest = poly[..., k]
        total = rest * weights[k - 1]
        for i in range(k - 1, 0, -1):
            rest = poly[..., i] - s * rest
            total = total + rest * weights[i - 1]
        outside = poly[..., :k] @ weights / np.where(s > 0, s, 1)
        yield value * np.where(met, (1 - s) * total, -s * outside)


def _columns(leaves: list[tuple[float, dict]]) -> tuple[np.ndarray, ...]:
    """Values of leaves of k features, and [leaf, feature]: numbers, bounds and shares."""
    feature = np.array([list(p) for _, p in leaves])
    low, high, share = np.array([list(p.values()) for _, p in leaves]).transpose(2, 0, 1)
    return np.array([v for v, _ in leaves]), feature, low, high, share


def _spread(feature: np.ndarray, width: int) -> np.ndarray:
    spread = np.zeros((len(feature), width))
    spread[np.arange(len(feature)), feature] = 1.0
    return spread


def _row_by_row(leaves: list[tuple[float, dict]], x: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of leaves that all have k features."""
    value, feature, low, high, share = _columns(leaves)
    values = x[:, feature]  # row, leaf, feature
    for f, found in zip(feature.T, _gains((values > low) & (values <= high), share, value)):
        out += found @ _spread(f, out.shape[1])


def _by_pattern(leaves: list[tuple[float, dict]], x: np.ndarray, out: np.ndarray) -> None:
    """Add the contributions of leaves that all have k features. They hang only
    on which of the k features a row is inside of, so they are worked out for
    the 2^k patterns and looked up for the rows."""
    value, feature, low, high, share = _columns(leaves)
    k, width = feature.shape[1], out.shape[1]
    patterns = (np.arange(1 << k)[:, None, None] >> np.arange(k) & 1).astype(bool)
    tables = [(np.ascontiguousarray(found.T).ravel(), _spread(f, width))
              for f, found in zip(feature.T, _gains(np.broadcast_to(patterns, (1 << k, *feature.shape)), share, value))]
    steps, edges = [], []
    for f in np.unique(feature):
        # a value is inside the same leaves as the bound that ends its stretch; a missing one is inside none
        leaf, place = np.nonzero(feature == f)
        edge = np.unique(np.concatenate([low[leaf, place], high[leaf, place], [-np.inf, np.inf]]))
        ends = np.append(edge, np.nan)[:, None]
        step = np.zeros((len(ends), len(leaves)), np.int64)
        step[:, leaf] = ((ends > low[leaf, place]) & (ends <= high[leaf, place])) << place
        steps.append(step)
        edges.append((f, edge))
    start = np.arange(len(leaves)) << k
    rows = max(1, _LOOKUPS // len(leaves))
    for r in range(0, len(x), rows):
        part = x[r : r + rows]
        at = np.repeat(start[None], len(part), 0)
        for step, (f, edge) in zip(steps, edges):
            at += step.take(np.searchsorted(edge, part[:, f], "left"), 0)
        for table, spread in tables:
            out[r : r + rows] += table.take(at) @ spread


def tree_contributions(leaves: list[tuple[float, dict]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions per row and feature of a tree's leaves, and their base value."""
    out = np.zeros_like(x)
    base = sum(v * float(np.prod([s for _, _, s in p.values()])) for v, p in leaves)
    by: dict[int, list] = {}
    for v, p in leaves:
        if p and v != 0.0:
            by.setdefault(len(p), []).append((v, p))
    for k, mine in by.items():
        if 1 << k <= len(x):
            step = max(1, _CELLS // (k + 1 << k))
            for i in range(0, len(mine), step):
                _by_pattern(mine[i : i + step], x, out)
            continue
        for r in range(0, len(x), _ROWS):
            step = max(1, _CELLS // (_ROWS * (k + 1)))
            for i in range(0, len(mine), step):
                _row_by_row(mine[i : i + step], x[r : r + _ROWS], out[r : r + _ROWS])
    return out, base


_TREE = ("tree", "node", "feature", "cut", "left", "right", "cover", "value")


def _tree_blocks(model: TreeModel) -> tuple[DataFrame, int]:
    """(block, trees): the nodes of each block of trees as bytes."""
    size = model.nodes.agg(F.count(F.lit(1)), F.count_distinct("tree")).first()
    blocks = max(1, min(size[1], -(-size[0] // NODES_PER_BLOCK)))

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(_TREE).schema) as writer:
            writer.write_table(table.select(_TREE))
        return pa.table({"block": table["block"][:1], "trees": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    numbered = model.nodes.select((F.col("tree") % blocks).cast("int").alias("block"), *_TREE)
    return numbered.groupBy("block").applyInArrow(pack, "block int, trees binary"), blocks


def _unpacked(data: bytes) -> list[list[tuple[float, dict]]]:
    table = pa.ipc.open_stream(data).read_all()
    columns = {c: table[c].to_numpy() for c in _TREE}
    return [_paths({c: v[columns["tree"] == t] for c, v in columns.items()}) for t in np.unique(columns["tree"])]


def contributions(model: TreeModel, df: DataFrame, features: Sequence[str], sample_id: str = "sample_id") -> DataFrame:
    """Contribution of every feature to the attack probability of every row,
    as rows (id, feature, contribution) plus the base value."""
    spark, width, trees = df.sparkSession, len(features), max(model.trees, 1)
    ship_package(spark)
    blocks, count = _tree_blocks(model)
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(quoted(sample_id)).cast("long")
    rows = df.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share"),
                     F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("trees"), key.alias("id"), features_of(df, features).alias("x"))
    heads = staged(blocks, "blocks").select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "trees",
                                            F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x"))
    # a task has one block and one share: its trees come first, then the rows that pass them by
    stream = heads.unionByName(rows).repartitionById(count * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions("kind").select("trees", "id", "x")

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = []
        for batch in batches:
            marks = np.flatnonzero(batch.column("trees").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([-1, *marks], [*marks, batch.num_rows]):
                if start >= 0:
                    forest = _unpacked(batch.column("trees")[start].as_py())
                part = batch.slice(start + 1, end - start - 1)
                if not part.num_rows:
                    continue
                x = matrix(part.column("x"), width)
                total, base = np.zeros_like(x), 0.0
                for leaves in forest:
                    phi, b = tree_contributions(leaves, x)
                    total, base = total + phi, base + b
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(total / trees), pa.list_(pa.float64())), pa.array(np.full(len(x), base / trees))], names=["id", "phi", "base"])

    out = stream.mapInArrow(explain, "id long, phi array<double>, base double")
    # a row moves once with all its sums
    sums = out.groupBy("id").agg(F.array(*[F.sum(F.get("phi", F.lit(i))) for i in range(width)]).alias("phi"), F.sum("base").alias("base"))
    names = F.array(*[F.lit(c) for c in features])
    return sums.select("id", "base", F.posexplode("phi").alias("pos", "contribution")).select(
        "id", F.get(names, F.col("pos")).alias("feature"), "contribution", "base")


def mean_contributions(contrib: DataFrame, top: int | None = 30) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    out = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    out = out.orderBy(F.col("mean_abs_contribution").desc(), "feature")
    return out if top is None else out.limit(top)


def explain_forest(model: TreeModel, df: DataFrame, features: Sequence[str], sample_id: str = "sample_id", max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Top features over all rows, or over a sample of ``max_rows``."""
    filled = impute_own(df, features)
    rows = sample_exact(filled, max_rows, sample_id, seed) if max_rows else filled
    return mean_contributions(contributions(model, rows, features, sample_id))
