"""Toxicity by character n-grams scaled with naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. Each n-gram's value is the
log ratio of its smoothed frequencies among toxic and other texts; a logistic
model is fitted on these values. Only the n-grams that separate the classes
best get a weight, so scoring a text is a table look-up per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.llm.common import Scratch, append_columns, col, crc_bucket
from flowspark.llm.labelled import fitted_rows, labelled_sample

_SLICE = 1 << 18  # characters hashed at a time
MOD, HELD_OUT, CUT = 3, 1, 0.7


@dataclass(frozen=True)
class Config:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    #: Bound of the sample the model is fitted on: ids and bytes of a text.
    max_rows: int = 12_000
    max_bytes: int = 1 << 18
    #: N-grams that get a weight: those with the largest G statistic, at least ``least_gain``.
    features: int = 8_192
    least_gain: float = 25.0
    smoothing: float = 1.0
    ridge: float = 1e-4
    steps: int = 300


@dataclass(frozen=True)
class Model:
    config: Config
    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(1 << self.config.bits, np.float32)
        t[self.ids] = self.weights
        return t


def ngram_ids(text: str | None, config: Config) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text with a blank at both ends, by
    slices of the text that overlap so that none is lost."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    last = max(config.orders)
    for i in range(0, len(codes), _SLICE):
        part = codes[i : i + _SLICE + last - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, last + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in config.orders:
                m = h ^ (h >> np.uint32(15))
                yield (m * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - config.bits)


def _distinct(text: str | None, config: Config) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *ngram_ids(text, config)]))


def _active(text: str | None, config: Config, table: np.ndarray) -> np.ndarray:
    found = [ids[table[ids] != 0] for ids in ngram_ids(text, config)]
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *found]))


def _count(sample: DataFrame, config: Config) -> DataFrame:
    """(id, p, q): texts with the n-gram among toxic and other ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << config.bits), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(y > 0), _distinct(text, config)] += 1
        ids = np.flatnonzero(counts.sum(0))
        for i in range(0, len(ids), 1 << 16):
            k = ids[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[1, k].astype(np.int64)), pa.array(counts[0, k].astype(np.int64))], names=["id", "p", "q"])

    return sample.select("y", "text").mapInArrow(run, "id long, p long, q long").groupBy("id").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def _logistic(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, config: Config) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows; ``rows`` names the row of each id."""
    n, k = len(y), len(values)
    w, b, m, v = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, config.steps + 1):
        z = np.bincount(rows, (w * values)[ids], n) + b
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(ids, err[rows], k) * values / n + config.ridge * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Fit on ``labels.toxic``; without labelled texts every score is 0.5. Ids
    may be of any type; an empty table of documents is one without labels."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(labelled_sample(docs, labels, "toxic", MOD, HELD_OUT, config.max_rows, config.max_bytes), "sample")
    totals = {int(r["y"] > 0): r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tp, tq = totals.get(1, 0), totals.get(0, 0)
    if not tp + tq:
        return Model(config, np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0)
    a = config.smoothing
    counted = _count(sample, config)
    ratio = F.log((F.col("p") + a) / (tp + 2 * a)) - F.log((F.col("q") + a) / (tq + 2 * a))

    def part(seen, seen_by_chance):  # one cell of the G statistic of a 2 x 2 table
        return F.when(seen > 0, seen * F.log(seen / seen_by_chance)).otherwise(0.0)

    n, has = float(tp + tq), F.col("p") + F.col("q")
    gain = 2 * (part(F.col("p"), has * (tp / n)) + part(F.col("q"), has * (tq / n)) + part(tp - F.col("p"), (n - has) * (tp / n)) + part(tq - F.col("q"), (n - has) * (tq / n)))
    best = counted.select("id", ratio.alias("r"), gain.alias("g")).where(F.col("g") >= config.least_gain).orderBy(F.desc("g"), "id").limit(config.features).toArrow()
    order = np.argsort(best["id"].to_numpy())
    chosen, r = best["id"].to_numpy()[order].astype(np.uint32), best["r"].to_numpy()[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << config.bits, np.float32)
        table[chosen] = 1
        for batch in batches:
            found = [np.searchsorted(chosen, _active(t, config, table)).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "ids"])

    schema = T.StructType([sample.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = fitted_rows(sample.mapInArrow(run, schema), config.max_rows)
    scratch.drop(sample)
    found = rows["ids"].combine_chunks()
    lengths = np.diff(found.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    y = (rows["y"].to_numpy() > 0).astype(float)
    w, b = _logistic(np.repeat(np.arange(len(y)), lengths), found.flatten().to_numpy(), r, y, config)
    return Model(config, chosen, (w * r).astype(np.float32), b)


def score_texts(texts: list[str | None], model: Model, table: np.ndarray) -> np.ndarray:
    z = np.array([float(table[_active(t, model.config, table)].sum(dtype=np.float64)) for t in texts]) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of being toxic in ``name`` (replacing a
    column of that name). Null texts score like empty ones; whole texts count,
    however long; each row is scored for itself."""

    def make(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        table = model.table()
        for batch in batches:
            yield batch, pa.array(score_texts(batch.column(at).to_pylist(), model, table), pa.float64())

    return append_columns(docs, text, {name: T.DoubleType()}, make)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without those that score ``cut`` or more. Every row is judged
    for itself: null and empty texts alike, repeated rows alike, long texts as a
    whole; an empty table stays empty."""
    return with_toxicity(docs, fit(docs, labels), name="__toxicity").where(F.col("__toxicity") < cut).drop("__toxicity")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = with_toxicity(docs.select("doc_id", "text"), model, name="score")
    return out.select("doc_id", (crc_bucket(col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
