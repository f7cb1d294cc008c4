"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt into lists around centroids fitted on a bounded sample, every
list into blocks of bounded size. A query probes its nearest lists; within a
block the rotated candidates stand in column blocks, and after each column
block a hypothesis test on the partial distance drops candidates that are
unlikely to come within the query's bound. What is left is measured exactly on
the original vectors. The bound is the k-th distance in the nearest list.

How many lists to probe is set by an audit on the sample: as many as hold the
wanted share of its true neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from flowspark.llm.common import Scratch, col
from flowspark.llm.vectors import distances, matrix, usable, vector_size


@dataclass(frozen=True)
class Config:
    k: int = 10
    #: Bound of the sample that centroids and the probe audit are fitted on.
    sample: int = 8_192
    audits: int = 512
    recall: float = 0.98
    max_lists: int = 4_096
    #: Rows and queries of a list that meet in one task.
    block_rows: int = 4_096
    query_rows: int = 16_384
    columns: int = 16
    #: Width of the test: larger is safer and slower.
    epsilon: float = 2.1
    seed: int = 11


_TILE = 1 << 21  # distances held at a time


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


@dataclass(frozen=True)
class Index:
    """What every task needs: bounded by ``max_lists`` centroids."""

    centroids: np.ndarray
    probes: int


def fit_index(sample: np.ndarray, n: int, config: Config) -> Index:
    """Centroids by a few rounds of k-means, and the audited probe count."""
    rng, s = np.random.default_rng(config.seed), sample.astype(np.float32)
    lists = int(np.clip(np.sqrt(n) / 2, 1, min(config.max_lists, len(s))))
    c = s[rng.permutation(len(s))[:lists]]
    for _ in range(8):
        at = _squared(s, c).argmin(1)
        sizes = np.bincount(at, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, at, s)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c).astype(np.float32)
    at = _squared(s, c).argmin(1)
    q = np.arange(min(config.audits, len(s)))
    d = _squared(s[q], s)
    d[q, q] = np.inf
    near = np.argsort(d, 1)[:, : min(config.k, max(1, len(s) - 1))]
    place = np.argsort(np.argsort(_squared(s[q], c), 1), 1)  # how near each list is to each query
    ranks = np.take_along_axis(place, at[near], 1)
    return Index(c, int(np.quantile(ranks, config.recall, method="higher")) + 1)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest per query, ties to smaller ids."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - start < k]


def scan_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, distance) of each query's k nearest in a
    block that are no farther than its bound (infinite: the k nearest)."""
    size = x.shape[1]
    turn = rotation(size, config.seed)
    xr, qr = x.astype(np.float32) @ turn, q.astype(np.float32) @ turn
    slack = 1e-4 * (1 + (qr * qr).sum(1))  # single precision is off by less
    found = []
    tile = max(1, _TILE // max(1, len(x)))
    for i in range(0, len(q), tile):
        rows = np.arange(i, min(i + tile, len(q)))
        limit = np.square(bounds[rows])
        free = np.isinf(limit)
        if free.any():
            d = _squared(qr[rows[free]], xr)
            d[qids[rows[free]][:, None] == ids] = np.inf
            limit[free] = np.partition(d, min(config.k, len(x)) - 1, 1)[:, min(config.k, len(x)) - 1]
        done = min(config.columns, size)
        part = _squared(qr[rows][:, :done], xr[:, :done])
        widen = lambda d: (d / size) * (1 + config.epsilon / np.sqrt(d)) ** 2 if d < size else 1.0
        r, c = np.nonzero(part <= (limit * widen(done) + slack[rows])[:, None])
        p = part[r, c]
        while done < size:
            step = min(config.columns, size - done)
            diff = xr[c, done : done + step] - qr[rows[r], done : done + step]
            p = p + (diff * diff).sum(1)
            done += step
            keep = p <= limit[r] * widen(done) + slack[rows[r]]
            r, c, p = r[keep], c[keep], p[keep]
        keep = ids[c] != qids[rows[r]]
        found.append((rows[r[keep]], c[keep]))
    r, c = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    score = np.concatenate([np.zeros(0), *[distances(q[r[j : j + (1 << 16)]], x[c[j : j + (1 << 16)]]) for j in range(0, len(r), 1 << 16)]])
    keep = score <= bounds[r]
    r, c, score = r[keep], c[keep], score[keep]
    best = _best(r, ids[c], score, config.k)
    return r[best], c[best], score[best]


_RESULT = "query_id long, vec_id long, score double"


def nearest(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", config: Config = Config()) -> DataFrame:
    """The ``config.k`` nearest rows of each query other than itself:
    query_id, rank (from 1), vec_id, score (Euclidean distance).

    Ids are whole numbers. Vectors that are null, zero, of another length than
    most or with null or non-finite components take no part on either side,
    nor do rows without an id. Rows that repeat a query's id are its own;
    otherwise repeated rows are candidates each. A query id that is repeated
    is asked once, with its smallest vector. Fewer candidates than k give fewer
    rows; empty tables none. Ties go to the smaller id.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    rows = rows.select(col(vec_id).cast("long").alias("vec_id"), col(vector).alias("vector"))
    size = vector_size(rows, "vector")
    ok = F.col("vec_id").isNotNull() & usable(F.col("vector"), size)
    rows = rows.where(ok)
    chosen = rows.select("vector", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(config.sample).select("vector").toArrow()
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(matrix(chosen["vector"], size, np.float32), n, config)

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(1), size, np.float32)
            at = np.concatenate([np.zeros(0, np.int64), *[_squared(x[i : i + 4096], index.centroids).argmin(1) for i in range(0, len(x), 4096)]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["vec_id", "vector", "list"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = scratch.write(rows.mapInArrow(place, f"vec_id long, vector {kind}, list int"), "placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / config.block_rows).cast("int").alias("blocks"))  # a row per list
    sizes = scratch.write(sizes, "lists")

    def probe(batches):
        for batch in batches:
            q = matrix(batch.column(1), size, np.float32)
            near = [np.argsort(_squared(q[i : i + 1024], index.centroids), 1, kind="stable")[:, : index.probes].astype(np.int32) for i in range(0, len(q), 1024)]
            lists = np.concatenate([np.zeros((0, index.probes), np.int32), *near]) if near else np.zeros((0, 1), np.int32)
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * lists.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lists.ravel()))], names=["query_id", "query", "lists"])

    asked = queries.select(col(vec_id).cast("long").alias("vec_id"), col(vector).alias("vector")).where(ok).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.mapInArrow(probe, f"query_id long, query {kind}, lists array<int>").select("query_id", "query", F.posexplode("lists").alias("nth", "list"))
    asked = scratch.write(asked, "probes")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        if not len(ids) or not len(qids):
            r = c = np.zeros(0, int)
            score = np.zeros(0)
        else:
            r, c, score = scan_block(ids, matrix(left["vector"], size), qids, matrix(right["query"], size), right["bound"].to_numpy(), config)
        return pa.table({"query_id": pa.array(qids[r], pa.int64()), "vec_id": pa.array(ids[c], pa.int64()), "score": pa.array(score, pa.float64())})

    def search(probes: DataFrame) -> DataFrame:
        """Every block of a list's rows meets every part of its queries, so no task grows with the table."""
        parts = F.ceil(F.count(F.lit(1)) / config.query_rows).cast("int").alias("parts")
        grid = scratch.write(probes.groupBy("list").agg(parts).join(sizes, "list"), "grid")  # a row per list
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        keys = ["list", "block", "part"]
        left = placed.join(grid, "list").select("list", one("vec_id", "blocks").alias("block"), each("parts").alias("part"), "vec_id", "vector")
        right = probes.join(grid, "list").select("list", each("blocks").alias("block"), one("query_id", "parts").alias("part"), "query_id", "query", "bound")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, _RESULT)

    by_rank = W.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= config.k)
    first = scratch.write(top(search(asked.where("nth = 0").withColumn("bound", F.lit(float("inf"))))), "nearest-list")
    bounds = first.where(F.col("rank") == config.k).select("query_id", F.col("score").alias("__bound"))
    rest = asked.where("nth > 0").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("__bound", F.lit(float("inf"))))
    result = scratch.write(top(first.drop("rank").union(search(rest))), "nearest")
    scratch.drop(placed, sizes, asked, first)
    return result.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
with e as (select vec_id, embedding::double[] as v from embeddings),
p as (select q.vec_id as query_id, c.vec_id, list_distance(q.v, c.v) as score from e q join e c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from p) where rank <= 10
"""
