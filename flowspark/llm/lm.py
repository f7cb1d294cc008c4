"""Language-model scoring by the likelihood of the subword lattice.

A text is its lower-cased words and one end. A word is spelled by pieces of an
existing vocabulary, the first of which starts with the word mark; its
probability is the sum over all spellings of the product of the pieces'
probabilities, found by a forward recursion in log space over arrays of words
of equal length. Words do not share pieces, so a text's probability is the
product over its words and the end, and each distinct word is worked out once.

The pieces' scores start from the vocabulary's (a score that is a merge rank r
starts as the Zipf weight 1 / (r + 1)) and are refitted to the training words
by expectation maximisation: the expected number of uses of each piece over all
spellings. Every rerun of the corpus goes over distinct words with counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import Scratch, col, crc_bucket, words_of
from flowspark.llm.pieces import _LONG, _codes, MODEL_FILE, Vocabulary, load_vocabulary

MOD, HELD_OUT = 7, 2
END = b""  # words are never empty, so this stands for the end of a text
_WORDS = 1 << 16  # distinct words worked out at a time
_FLUSH = 1 << 18  # distinct words a task gathers before it sends their counts on
_KEPT = 400_000  # rare words whose scores a worker remembers from one part of a batch to the next


@dataclass(frozen=True)
class Config:
    model_file: str = MODEL_FILE
    rounds: int = 3
    #: Words whose counts travel to every task; all others are joined.
    frequent: int = 65_536
    #: Added to each piece's and byte's expected uses, so that all have some.
    smoothing: float = 0.1


def _log_sum(terms: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Log of the sum of exp over terms (places, values), per place."""
    top = np.full(n, -np.inf)
    for rows, x in terms:
        top[rows] = np.maximum(top[rows], x)
    total, base = np.zeros(n), np.where(top > -np.inf, top, 0)
    for rows, x in terms:
        total[rows] += np.exp(x - base[rows])
    with np.errstate(divide="ignore"):
        return base + np.log(total)


class Lattice:
    """Log probabilities of pieces, single bytes of unknown characters and the end."""

    def __init__(self, v: Vocabulary, pieces: np.ndarray, byte: np.ndarray, end: float):
        self.v, self.pieces, self.byte, self.end = v, pieces, byte, end

    def _unknown(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of characters by their UTF-8 bytes."""
        out = {c: float(self.byte[list(chr(c).encode("utf-8", "surrogatepass"))].sum()) for c in np.unique(codes).tolist()}
        return np.array([out[c] for c in codes.tolist()])

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Log sums over all spellings of each prefix, and the arcs of each
        end: (length, words, piece index or -1, log probability)."""
        length, n = codes.shape
        a = np.full((length + 1, n), -np.inf)
        a[0] = 0
        arcs: list[list] = [[] for _ in range(length + 1)]
        for end, size, rows, at in self.v.arcs(codes):
            if size == 1:
                if end > 1:
                    a[end - 1] = _log_sum([(rows, a[end - 1 - size, rows] + p) for size, rows, _, p in arcs[end - 1]], n)
                if len(rows) < n:
                    missing = np.setdiff1d(np.arange(n), rows, assume_unique=True)
                    arcs[end].append((1, missing, None, self._unknown(codes[end - 1, missing])))
            if len(rows):
                arcs[end].append((size, rows, at, self.pieces[at]))
        a[length] = _log_sum([(rows, a[length - size, rows] + p) for size, rows, _, p in arcs[length]], n)
        return a, arcs

    def uses(self, codes: np.ndarray, counts: np.ndarray, pieces: np.ndarray, byte: np.ndarray) -> None:
        """Add the expected uses of pieces and bytes over ``counts`` words each."""
        a, arcs = self.forward(codes)
        length, n = codes.shape
        # b: log sums of the ways from each position to the end, gathered arc by arc
        ahead: list[list] = [[] for _ in range(length + 1)]
        b = np.zeros((length + 1, n))
        for end in range(length, 0, -1):
            if end < length:
                b[end] = _log_sum(ahead[end], n)
            for size, rows, at, p in arcs[end]:
                on = p + b[end, rows]
                ahead[end - size].append((rows, on))
                share = np.exp(a[end - size, rows] + on - a[length, rows]) * counts[rows]
                if at is not None:
                    pieces += np.bincount(at, share, len(pieces))
                else:
                    for c, s in zip(codes[end - 1, rows].tolist(), share.tolist(), strict=True):
                        np.add.at(byte, list(chr(c).encode("utf-8", "surrogatepass")), s)

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, codes) of words by length, long ones cut where no piece
        reaches across: their parts multiply. Places name the whole word."""
        by: dict[int, tuple[list[int], list[str]]] = {}
        for i, w in enumerate(words):
            text = " " + w.decode("utf-8", "replace")
            for part in self.v.split(text) if len(text) > _LONG else [text]:
                places, parts = by.setdefault(len(part), ([], []))
                places.append(i)
                parts.append(part)
        for length, (places, parts) in by.items():
            rows = max(1, (1 << 19) // (length + 1))
            for i in range(0, len(parts), rows):
                yield np.array(places[i : i + rows]), _codes(parts[i : i + rows])

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for places, codes in self.groups(words):
            np.add.at(out, places, self.forward(codes)[0][-1])
        return out


def start_lattice(v: Vocabulary) -> Lattice:
    """Zipf weights from the vocabulary's ranks; bytes and the end share a little."""
    weight = 1 / (v.scores.max() - v.scores + 1)
    p = np.log(weight / weight.sum() * 0.9)
    return Lattice(v, p, np.full(256, np.log(0.05 / 256)), np.log(0.05))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``docs``, ends included as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) >= _FLUSH:
                    yield sent()
        yield sent()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, config: Config = Config()) -> Lattice:
    """Expectation maximisation over the distinct words of ``counts``. What
    comes to the driver each round is a number per piece and byte."""
    v = load_vocabulary(config.model_file)
    lattice, n = start_lattice(v), len(v.keys)
    for _ in range(config.rounds):

        def run(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
            pieces, byte, ends = np.zeros(n), np.zeros(256), 0
            for batch in batches:
                for i in range(0, batch.num_rows, _WORDS):
                    words, c = batch.column(0).slice(i, _WORDS).to_pylist(), batch.column(1).slice(i, _WORDS).to_numpy()
                    real = [k for k, w in enumerate(words) if w]
                    ends += int(c.sum() - c[real].sum())
                    c = c[real].astype(float)
                    for places, codes in lattice.groups([words[k] for k in real]):
                        lattice.uses(codes, c[places], pieces, byte)
            uses = np.concatenate([pieces, byte, [ends]])
            ids = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(uses[ids])], names=["id", "uses"])

        got = counts.mapInArrow(run, "id long, uses double").groupBy("id").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(n + 257, config.smoothing)
        uses[got["id"].to_numpy()] += got["uses"].to_numpy()
        p = np.log(uses / uses.sum())
        lattice = Lattice(v, p[:n], p[n : n + 256], float(p[-1]))
    return lattice


class _Ids(dict):
    """Numbers of words, given out as words are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_memory: dict[str, tuple[_Ids, np.ndarray, np.ndarray]] = {}


def _text_rows(docs: DataFrame, lattice: Lattice, common: dict[bytes, int], run_id: str) -> DataFrame:
    """Per row its id, fold, tokens, score, and of its words: the base sum and
    number of known tokens over frequent words, and the rest as (key, n)."""
    frequent = [w for w in common if w]
    scores = lattice.log_probabilities(frequent)
    logs = np.log10(np.array([common[w] for w in frequent], float) + 1)
    end, end_log, end_known = lattice.end, float(np.log10(common.get(END, 0) + 1)), int(END in common)
    most = len(frequent)

    def fresh() -> tuple[_Ids, np.ndarray, np.ndarray]:
        """Numbers of the frequent words, the scores of all numbered words and the keys of those that are not frequent."""
        return _Ids(zip(frequent, range(most), strict=True)), scores, np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run_id not in _memory:
            _memory.clear()
        ids, score_of, key_of = _memory.get(run_id) or fresh()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                if len(ids) - most > _KEPT:
                    ids, score_of, key_of = fresh()
                met = []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    met.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                new = list(islice(ids, len(score_of), None))
                if new:
                    score_of = np.concatenate([score_of, *[lattice.log_probabilities(new[k : k + _WORDS]) for k in range(0, len(new), _WORDS)]])
                    key_of = np.concatenate([key_of, np.array([xxhash.xxh64_intdigest(w, 42) for w in new], np.uint64).view(np.int64)])
                _memory[run_id] = ids, score_of, key_of
                n, sizes = len(met), np.array([len(x) for x in met])
                word, row = np.concatenate(met), np.repeat(np.arange(n), sizes)
                score = (end + np.bincount(row, score_of[word], n)) / np.log(10)
                often = word < most
                hits = end_known + np.bincount(row[often], minlength=n)
                base = end_log + np.bincount(row[often], logs[word[often]], n)
                rare, times = np.unique(row[~often] * len(ids) + word[~often], return_counts=True)
                offsets = pa.array(np.searchsorted(rare, np.arange(n + 1) * len(ids)).astype(np.int32))
                keys = pa.ListArray.from_arrays(offsets, pa.array(key_of[rare % max(len(ids), 1) - most]))
                times = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, (sizes + 1, score, base, hits)), keys, times],
                                                 names=["doc_id", "held_out", "n_tokens", "score", "base", "known", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, score double, base double, known long, rare array<long>, times array<int>")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: Config = Config()) -> DataFrame:
    """Score every text by a model of the texts outside the held out fold.

    A row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Null and empty texts are their end alone. Repeated rows
    count as often as they stand there. Without training texts nothing is
    known and the pieces keep an even share. Counts of frequent words travel to
    the tasks (their number is bounded by ``config.frequent``), those of all
    other words are joined by a 64-bit hash of the word.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).withColumn("held_out", crc_bucket(F.col("doc_id"), MOD) == HELD_OUT)
    counts, seen = scratch.write(word_counts(docs.where(~F.col("held_out"))), "counts", {"n": F.coalesce(F.sum("c"), F.lit(0)), "v": F.count(F.lit(1))})
    n, v = seen["n"], seen["v"]
    lattice = fit(counts, config)
    common = counts.orderBy(F.desc("c"), "word").limit(config.frequent).toArrow()
    common = dict(zip(common["word"].to_pylist(), common["c"].to_pylist(), strict=True))
    run_id = f"{scratch.paths[id(counts)][1]}"
    rows = scratch.write(_text_rows(docs, lattice, common, run_id).withColumn("row", F.monotonically_increasing_id()), "texts")
    least = min(common.values(), default=0) if len(common) == config.frequent else None
    rest = counts.where(F.lit(least is not None)) if least is None else counts.where(F.col("c") <= least)
    rest = rest.select(F.xxhash64(F.col("word").cast("string")).alias("rare"), F.log10(F.col("c") + 1.0).alias("log_c"))
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    found = asked.join(rest, "rare").groupBy("row").agg(F.sum(F.col("times") * F.col("log_c")).alias("more"), F.sum("times").alias("more_known"))
    out = rows.drop("rare", "times").join(found, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
                      base.alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
