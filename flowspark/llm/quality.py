"""Document quality by a byte-level convolutional network.

Filters slide over the bytes of a text; each looks its taps up in a table with
a value per byte, so no byte embedding is multiplied out. Their rectified
responses are max-pooled over chunks of ``2 * block`` bytes that overlap by
half and together cover the whole text, the chunks' maxima are pooled over the
text (mean and maximum), and a logistic unit makes one probability of them.
Filters and unit are trained together by back-propagation through the maxima.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.llm.common import Scratch, append_columns, col, crc_bucket
from flowspark.llm.labelled import fitted_rows, labelled_sample

MOD, HELD_OUT, CUT = 5, 0, 0.3
_BATCH = 1 << 19  # bytes convolved at a time; longer texts are cut at block edges


@dataclass(frozen=True)
class Config:
    width: int = 4
    filters: int = 8
    block: int = 128
    #: Bound of the sample the network is fitted on: ids and bytes of a text.
    max_rows: int = 3_000
    max_bytes: int = 1 << 15
    steps: int = 600
    group: int = 64
    rate: float = 0.02
    seed: int = 7


@dataclass(frozen=True)
class Model:
    config: Config
    taps: np.ndarray  # (width, 256, filters)
    shift: np.ndarray  # (filters,)
    unit: np.ndarray  # (2 * filters + 1,)

    def pairs(self) -> list[np.ndarray]:
        """Tables of two neighbouring taps, indexed by two bytes at once."""
        c = self.config
        return [(self.taps[j][:, None, :] + self.taps[j + 1][None, :, :]).reshape(65536, c.filters) for j in range(0, c.width - 1, 2)]


def _blocks(text: np.ndarray, config: Config) -> np.ndarray:
    """Bytes of the text's blocks, one row each, with the ``width - 1`` bytes
    that follow; the text is padded with zero bytes to at least two blocks."""
    n = max(2, -(-len(text) // config.block))
    padded = np.zeros(n * config.block + config.width, np.uint8)
    padded[: len(text)] = text
    step = padded.strides[0]
    return np.lib.stride_tricks.as_strided(padded, (n, config.block + config.width), (config.block * step, step), writeable=False)


def _block_maxima(blocks: np.ndarray, pairs: list[np.ndarray], config: Config) -> np.ndarray:
    """Largest response of each filter in each block, before the shift."""
    two = (blocks[:, :-1].astype(np.uint16) << 8) | blocks[:, 1:]
    total = None
    for i, table in enumerate(pairs):
        part = table[two[:, 2 * i : 2 * i + config.block]]
        total = part if total is None else np.add(total, part, out=total)
    return total.max(1)


def _pool(maxima: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Rectified chunk maxima from block maxima: a chunk is two neighbours."""
    return np.maximum(np.maximum(maxima[:-1], maxima[1:]) + shift, 0)


def score_texts(texts: list[str | None], model: Model, pairs: list[np.ndarray]) -> np.ndarray:
    c, f = model.config, model.config.filters
    at, rows, pending, held = [0], [], [], 0
    maxima = []

    def flush():
        nonlocal pending, held
        if pending:
            maxima.append(_block_maxima(np.concatenate(pending), pairs, c))
        pending, held = [], 0

    for t in texts:
        blocks = _blocks(np.frombuffer((t or "").encode(), np.uint8), c)
        rows.append(len(blocks))
        for i in range(0, len(blocks), _BATCH // c.block):
            part = blocks[i : i + _BATCH // c.block]
            pending.append(part)
            held += part.size
            if held >= _BATCH:
                flush()
    flush()
    if not rows:
        return np.zeros(0)
    at = np.concatenate(([0], np.cumsum(rows)))
    chunks = _pool(np.concatenate(maxima), model.shift)  # the last chunk of a text would reach into the next one
    first, n = at[:-1], np.array(rows) - 1
    bounds = np.stack([first, first + n], 1).ravel()[: 2 * len(rows) - 1]
    mean = np.add.reduceat(chunks, bounds, 0)[::2] / n[:, None]
    top = np.maximum.reduceat(chunks, bounds, 0)[::2]
    z = np.concatenate([mean, top, np.ones((len(rows), 1))], 1).astype(np.float64) @ model.unit.astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Adam:
    def __init__(self, *shapes):
        self.m, self.v, self.t = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes], 0

    def step(self, parameters, gradients, rate):
        self.t += 1
        for p, g, m, v in zip(parameters, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(p.dtype)


def _train(texts: list[bytes], y: np.ndarray, config: Config) -> Model:
    rng = np.random.default_rng(config.seed)
    w, f, block = config.width, config.filters, config.block
    taps = rng.normal(0, 0.3, (w, 256, f)).astype(np.float32)
    shift, unit = np.zeros(f, np.float32), np.append(rng.normal(0, 0.1, 2 * f), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))).astype(np.float32)
    docs = [_blocks(np.frombuffer(t, np.uint8), config) for t in texts]
    adam = _Adam(taps.shape, shift.shape, unit.shape)
    queue = np.zeros(0, np.int64)
    for step in range(config.steps):
        rate = config.rate * (1 - step / config.steps) + 1e-4
        while len(queue) < config.group:
            queue = np.concatenate([queue, rng.permutation(len(docs))])
        pick, queue = queue[: config.group], queue[config.group :]
        gt, gs, gu = np.zeros_like(taps), np.zeros_like(shift), np.zeros_like(unit)
        for d in pick:
            b = docs[d]
            conv = taps[0][b[:, :block]]
            for j in range(1, w):
                conv += taps[j][b[:, j : j + block]]
            place = conv.argmax(1)  # (blocks, filters)
            best = np.take_along_axis(conv, place[:, None, :], 1)[:, 0]
            left = best[:-1] >= best[1:]
            chunk = np.where(left, best[:-1], best[1:]) + shift
            pooled = np.maximum(chunk, 0)
            top = pooled.argmax(0)
            x = np.concatenate([pooled.mean(0), pooled[top, np.arange(f)], [1]]).astype(np.float32)
            err = 1 / (1 + np.exp(-np.clip(x @ unit, -40, 40))) - y[d]
            gu += err * x
            gp = np.broadcast_to(err * unit[:f] / len(pooled), pooled.shape).copy()
            gp[top, np.arange(f)] += err * unit[f : 2 * f]
            gp *= chunk > 0
            gs += gp.sum(0)
            row = np.arange(len(gp))[:, None] + ~left  # block that holds the chunk's maximum
            at = place[row, np.arange(f)]
            for j in range(w):
                np.add.at(gt[j], (b[row, at + j], np.broadcast_to(np.arange(f), row.shape)), gp)
        n = len(pick)
        adam.step([taps, shift, unit], [gt / n + 1e-5 * taps, gs / n, gu / n + 1e-4 * unit], rate)
    return Model(config, taps, shift, unit)


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Fit on ``labels.quality``; without labelled texts every score is 0.5."""
    Scratch(docs.sparkSession, "quality")
    sample = labelled_sample(docs, labels, "quality", MOD, HELD_OUT, config.max_rows, config.max_bytes)
    rows = fitted_rows(sample, config.max_rows)
    if not len(rows):
        f = config.filters
        return Model(config, np.zeros((config.width, 256, f), np.float32), np.zeros(f, np.float32), np.zeros(2 * f + 1, np.float32))
    return _train([t.encode() for t in rows["text"].to_pylist()], (rows["y"].to_numpy() > 0).astype(np.float32), config)


def with_quality(docs: DataFrame, model: Model, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with the probability of good quality in ``name`` (replacing a
    column of that name). Null texts score like empty ones (all padding);
    every byte of a text is seen, however long; each row counts for itself."""

    def make(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        pairs = model.pairs()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part, pa.array(score_texts(part.column(at).to_pylist(), model, pairs), pa.float64())

    return append_columns(docs, text, {name: T.DoubleType()}, make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = with_quality(docs.select("doc_id", "text"), model, name="score")
    return out.select("doc_id", (crc_bucket(col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
