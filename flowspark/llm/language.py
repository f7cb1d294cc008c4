"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to lower-case letters and marks with single blanks between
them. Every language has a model of its own: n-grams of each order as sorted
64-bit hashes with the log of their interpolated probability, and contexts as
sorted hashes with the log of the weight they leave to the next lower order.
A text is scored by the distinct n-grams of a block of texts: each is looked up
once per language and the values are summed per text. The language with the
lowest cross-entropy per symbol wins. A calibration share of the sample, whose
n-grams are not counted, sets the scale of the score and, per language, the
cross-entropy above which a text counts as none of the languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.llm.common import Scratch, append_columns, col, crc_bucket
from flowspark.staging import local_table

MOD, HELD_OUT = 5, 0
UNKNOWN = "und"
_START = 0x110000  # what stands before a text
_SLICE = 1 << 18  # characters of a text folded at a time
_BLOCK = 1 << 20  # symbols whose n-grams are looked up together
_BITS = 21  # of a symbol in a packed n-gram


@dataclass(frozen=True)
class Config:
    order: int = 4
    #: Bound of the sample: documents per language expected in it, whole texts, drawn by hash; and languages.
    max_docs: int = 2_000
    max_langs: int = 1_000
    #: One in so many sampled documents calibrates instead of being counted.
    calibrate: int = 5
    #: Share of a language's own calibration texts that its cut accepts.
    accept: float = 0.995


@dataclass
class Model:
    config: Config
    langs: list[str]
    multiplier: int
    symbols: int
    #: per language: [keys, log p] for each order and [keys, log weight] of each context length from 1
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]
    floors: list[float]
    scale: float = 0.05
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Folder:
    """Characters to symbols, looked up once each."""

    def __init__(self):
        self.to = np.full(_START + 1, -1, np.int32)
        self.to[_START] = _START
        self.letter = np.zeros(_START + 1, bool)

    def __call__(self, text: str) -> tuple[np.ndarray, bool]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.to[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                kind, low = unicodedata.category(chr(c)), chr(c).lower()
                self.to[c] = 32 if kind[0] not in "LM" else ord(low) if len(low) == 1 else c
                self.letter[c] = kind[0] == "L"
            out = self.to[codes]
        return out, bool(self.letter[codes].any())


def _folded(texts: list[str | None], order: int, fold: Folder, has_letter: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, symbols) of each slice; the first ``order - 1`` symbols are context only."""
    for i, t in enumerate(texts):
        before = np.full(order - 1, _START, np.int32)
        for s in range(0, len(t or ""), _SLICE):
            x, letters = fold(t[s : s + _SLICE])
            has_letter[i] |= letters
            last = np.append(before[-1:], x[:-1])
            x = np.concatenate((before, x[(x != 32) | ((last != 32) & (last != _START))]))
            yield i, x
            before = x[len(x) - order + 1 :]


def ngrams(texts: list[str | None], order: int, multiplier: int, fold: Folder, has_letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text of each slice, slice of each n-gram occurrence, its place
    among the distinct ones, distinct n-grams as rows of symbols)."""

    def block(parts: list[tuple[int, np.ndarray]]):
        symbols, sizes = np.concatenate([x for _, x in parts]), np.array([len(x) for _, x in parts])
        piece = np.repeat(np.arange(len(parts)), sizes)
        ends = np.flatnonzero(np.arange(len(symbols)) - (np.cumsum(sizes) - sizes)[piece] >= order - 1)
        h = np.zeros(len(ends), np.uint64)
        for k in range(order):
            h = h * np.uint64(multiplier) + symbols[ends - (order - 1 - k)].astype(np.uint64) + np.uint64(1)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        rows = symbols[ends[first][:, None] + np.arange(1 - order, 1)]
        return np.array([i for i, _ in parts]), piece[ends], place, rows

    parts, size = [], 0
    for i, x in _folded(texts, order, fold, has_letter):
        parts.append((i, x))
        size += len(x)
        if size >= _BLOCK:
            yield block(parts)
            parts, size = [], 0
    if parts:
        yield block(parts)


def hashes(rows: np.ndarray, multiplier: int) -> np.ndarray:
    """Hash of each row of symbols."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * np.uint64(multiplier) + rows[:, k].astype(np.uint64) + np.uint64(1)
    return h


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _distinct(rows: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, first row and place of each distinct row."""
    keys, first, place = np.unique(hashes(rows, multiplier), return_index=True, return_inverse=True)
    if not (rows == rows[first][place]).all():
        raise ValueError("n-gram hashes collide")
    return keys, first, place


def kneser_ney(rows: np.ndarray, counts: np.ndarray, symbols: int, multiplier: int):
    """(grams, contexts, floor) of one language from its n-grams of the highest
    order. Lower orders count distinct left neighbours, but occurrences where
    the n-gram begins a text. One absolute discount per order."""
    order = rows.shape[1]
    levels, raw = [], counts.astype(float)
    keys, first, _ = _distinct(rows, multiplier)
    rows, raw = rows[first], raw[first]
    levels.append((keys, rows, raw))
    for k in range(order - 1, 0, -1):
        shorter, (keys, first, place) = rows[:, 1:], _distinct(rows[:, 1:], multiplier)
        raw = np.bincount(place, raw)
        rows = shorter[first]
        levels.append((keys, rows, np.where(rows[:, 0] == _START, raw, np.bincount(place))))
    levels.reverse()
    grams, contexts, floor, lower = [], [], 0.0, None
    for k, (keys, rows, count) in enumerate(levels, 1):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once and twice else 0.75
        ctx_keys, _, ctx = _distinct(rows[:, :-1], multiplier) if k > 1 else (None, None, np.zeros(len(rows), np.int64))
        total, kinds = np.bincount(ctx, count), np.bincount(ctx)
        left = discount * kinds / total
        if k > 1:
            down = lower[np.searchsorted(levels[k - 2][0], hashes(rows[:, 1:], multiplier))]
            contexts.append((ctx_keys, np.log(left).astype(np.float32)))
        else:
            down, floor = 1 / symbols, float(np.log(left[0] / symbols))
        lower = (count - discount) / total[ctx] + left[ctx] * down
        grams.append((keys, np.log(lower).astype(np.float32)))
    return grams, contexts, floor


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def log_probabilities(rows: np.ndarray, model: Model) -> np.ndarray:
    """[n-gram, language]: natural log of the last symbol's probability after the others."""
    order = rows.shape[1]
    by_order = [hashes(rows[:, order - k :], model.multiplier) for k in range(1, order + 1)]
    by_context = [hashes(rows[:, order - k : -1], model.multiplier) for k in range(2, order + 1)]
    out = np.empty((len(rows), len(model.langs)))
    for i in range(len(model.langs)):
        lp = np.full(len(rows), model.floors[i])
        for k in range(order):
            if k:
                at, hit = _find(model.contexts[i][k - 1][0], by_context[k - 1])
                lp += np.where(hit, model.contexts[i][k - 1][1][at], 0)
            at, hit = _find(model.grams[i][k][0], by_order[k])
            lp = np.where(hit, model.grams[i][k][1][at], lp)
        out[:, i] = lp
    return out


def entropies(texts: list[str | None], model: Model, fold: Folder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, has a letter, [text, language] cross-entropy per symbol)."""
    n, has, total = np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros((len(texts), len(model.langs)))
    for owner, piece, place, rows in ngrams(texts, model.config.order, model.multiplier, fold, has):
        values = log_probabilities(rows, model)
        np.add.at(n, owner, np.bincount(piece, minlength=len(owner)))
        for i in range(len(model.langs)):
            # a slice is summed by itself, so a text's value doesn't hang on its neighbours
            np.add.at(total[:, i], owner, np.bincount(piece, values[place, i], len(owner)))
    return n, has, -total / np.maximum(n, 1)[:, None]


def predict(texts: list[str | None], model: Model, fold: Folder) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy in nats, rejected) of each text."""
    n, has, h = entropies(texts, model, fold)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    best = h.argmin(1) if len(h) else np.zeros(0, int)
    low = h[np.arange(len(h)), best]
    score = 1 / np.exp(-model.scale * n[:, None] * (h - low[:, None])).sum(1)
    far = (low - model.means[best]) * np.sqrt(n) > model.cuts[best]
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0), low, far | ~has


def _sample(docs: DataFrame, config: Config) -> DataFrame:
    """(lang, text, part) of the training documents that are drawn; part 0 calibrates."""
    known = docs.where(col("lang").isNotNull() & col("text").isNotNull() & (crc_bucket(col("doc_id"), MOD) != HELD_OUT))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(config.max_langs + 1).collect()
    if len(counts) > config.max_langs:
        raise ValueError(f"more than {config.max_langs} languages")
    rates = local_table(docs.sparkSession, [(r["lang"], config.max_docs / r["n"]) for r in counts], "__lang string, __rate double")
    drawn = F.xxhash64(col("doc_id"), col("text"))
    rows = known.select("lang", "text", drawn.alias("__h")).join(F.broadcast(rates), F.col("lang") == F.col("__lang"))
    return (rows.where(F.shiftrightunsigned("__h", 11) / float(1 << 53) < F.col("__rate"))
            .select("lang", "text", F.pmod(F.col("__h"), F.lit(config.calibrate)).cast("int").alias("part")))


def _pack(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to six symbols as two longs."""
    wide = np.zeros((len(rows), 6), np.int64)
    wide[:, : rows.shape[1]] = rows
    return tuple((wide[:, i] << 2 * _BITS) | (wide[:, i + 1] << _BITS) | wide[:, i + 2] for i in (0, 3))


def _unpack(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    mask = (1 << _BITS) - 1
    return np.stack([(x >> s) & mask for x in (a, b) for s in (2 * _BITS, _BITS, 0)], 1)[:, :order].astype(np.int32)


def _counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, a, b, n): occurrences of each n-gram, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folder()
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for _, _, place, rows in ngrams(own, order, _MULTIPLIERS[0], fold, np.zeros(len(own), bool)):
                    a, b = _pack(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(np.bincount(place, minlength=len(a)))], names=["lang", "a", "b", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def _calibrated(model: Model, truth: np.ndarray, n: np.ndarray, h: np.ndarray) -> Model:
    """Scale of the score by most likely labels, and each language's cut."""
    model.means, model.cuts = np.zeros(len(model.langs)), np.full(len(model.langs), np.inf)
    if not len(truth):
        return model
    own = h[np.arange(len(h)), truth]
    gaps = n[:, None] * (h - own[:, None])
    scales = np.logspace(-4, 0, 33)
    model.scale = float(scales[np.argmin([np.log(np.exp(np.clip(-s * gaps, -700, 700)).sum(1)).sum() for s in scales])])
    for i in range(len(model.langs)):
        mine = truth == i
        if mine.any():
            model.means[i] = np.average(own[mine], weights=n[mine])
            model.cuts[i] = np.quantile((own[mine] - model.means[i]) * np.sqrt(n[mine]), model.config.accept)
    return model


def fit(docs: DataFrame, config: Config = Config()) -> Model:
    """Models of the languages of ``docs`` (doc_id, text, lang), from rows
    outside the held out fold whose text and lang are not null."""
    scratch = Scratch(docs.sparkSession, "language")
    sample = scratch.write(_sample(docs, config), "sample")
    found = _counts(sample.where("part <> 0"), config.order).toArrow()
    langs = np.array(found["lang"].to_pylist(), object)
    rows, n = _unpack(found["a"].to_numpy(), found["b"].to_numpy(), config.order), found["n"].to_numpy()
    names = sorted(set(langs))
    symbols = len(np.unique(rows[:, -1])) + 1  # one for all symbols no language has
    for multiplier in _MULTIPLIERS:
        try:
            parts = [kneser_ney(rows[langs == x], n[langs == x], symbols, multiplier) for x in names]
            break
        except ValueError:
            if multiplier == _MULTIPLIERS[-1]:
                raise
    model = Model(config, names, multiplier, symbols, *([p[i] for p in parts] for i in range(3)))
    place = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folder()
        for batch in batches:
            size, has, h = entropies(batch.column(1).to_pylist(), model, fold)
            truth = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
            ok = has & (truth >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(truth[ok]), pa.array(size[ok]), pa.array(list(h[ok]), pa.list_(pa.float64()))], names=["truth", "n", "h"])

    held = sample.where("part = 0").select("lang", "text").mapInArrow(run, "truth long, n double, h array<double>").toArrow() if names else None
    scratch.drop(sample)
    if held is None or not len(held):
        return _calibrated(model, np.zeros(0, int), np.zeros(0), np.zeros((0, len(names))))
    return _calibrated(model, held["truth"].to_numpy(), held["n"].to_numpy(), np.array(held["h"].to_pylist()))


NEW = {"lang_pred": T.StringType(), "score": T.DoubleType(), "entropy": T.DoubleType(), "rejected": T.BooleanType()}


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (the language of lowest cross-entropy, ties to
    the first by code point; ``und`` for texts that are null or have no letter),
    ``score`` (its probability among the learned languages, 0 for ``und``),
    ``entropy`` (nats per symbol) and ``rejected`` (``und``, or farther from the
    language than its calibrated cut), replacing columns of these names. Whole
    texts count, however long; each row is scored for itself; without learned
    languages every row is ``und``; empty tables give empty results."""

    def make(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
        fold = Folder()
        for batch in batches:
            langs, score, low, rejected = predict(batch.column(at).to_pylist(), model, fold)
            yield batch, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(rejected, pa.bool_())

    return append_columns(docs, text, NEW, make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_language(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (crc_bucket(col("doc_id"), MOD) == HELD_OUT).alias("held_out"), *NEW)
