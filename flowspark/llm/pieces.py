"""SentencePiece encoding and decoding with batched numpy Viterbi.

A text is cut into words where no piece of the vocabulary can reach across.
Distinct words of equal length form one array and advance together: at each
end position the hashes of all substrings that end there probe the sorted piece
keys, and the vectorised maximum of the scores leaves a backpointer. Words seen
before come from a bounded cache of the task.

The segmentation is the one with the largest sum of piece scores (ties: the
longer last piece). On a model file of BPE type, whose scores are merge ranks,
this is the best-scoring segmentation, not the merge order's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.llm.common import append_columns
from flowspark.staging import ship_package

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000  # words a worker remembers
_CHARS = 1 << 22  # characters encoded at a time, but one text at least
_LONG = 48  # words of more characters are cut again between characters that no piece joins
_UNKNOWN_PENALTY = 10.0


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))), dtype=np.uint64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of the columns of ``codes``."""
    h = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    for i, c in enumerate(codes.astype(np.uint64)):
        h[i + 1] = h[i] * _BASE + c + np.uint64(1)
    return h


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a column each."""
    return np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).T)


_SLOTS = 20  # bits of a hash that tell whether a search is worth it


def _slots(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - _SLOTS)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as arrays, small enough to travel with a task."""

    texts: tuple[bytes, ...]  # what each id decodes to
    keys: np.ndarray  # sorted hashes of the pieces that text can match
    ids: np.ndarray  # their ids
    scores: np.ndarray  # their scores
    byte_ids: np.ndarray  # id of each byte
    hit: np.ndarray  # whether any key has these first bits
    joins: np.ndarray  # sorted character pairs that some piece holds
    longest: int
    alone: str  # white space characters that no longer piece holds

    @property
    def unknown(self) -> float:
        return float(self.scores.min()) - _UNKNOWN_PENALTY

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are pieces, and their places among the sorted keys."""
        rows = np.flatnonzero(self.hit[_slots(keys)])
        at = np.searchsorted(self.keys, keys[rows])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == keys[rows]
        return rows[same], at[same]

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, words, pieces) in order of end, then length."""
        h, powers = _prefix_hashes(codes), _powers(self.longest)
        for end in range(1, len(codes) + 1):
            for n in range(1, min(end, self.longest) + 1):
                yield end, n, *self.probe(h[end] - h[end - n] * powers[n])

    def split(self, word: str) -> list[str]:
        """A word cut between characters that no piece joins."""
        c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        pairs = c[:-1] << np.uint64(32) | c[1:]
        at = np.searchsorted(self.joins, pairs)
        at[at == len(self.joins)] = 0
        cuts = np.flatnonzero(self.joins[at] != pairs) + 1
        edges = [0, *cuts.tolist(), len(word)]
        return [word[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def load_vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    """Read a model file on the driver. A blank stands for the word mark, so
    that a literal mark in a text is an ordinary unknown character."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model_file)
    n = p.get_piece_size()
    byte_ids, texts, plain = np.full(256, -1, np.int32), [b""] * n, []
    for i in range(n):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts[i] = bytes([int(piece[3:5], 16)])
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            shown = piece.replace("▁", " ")
            texts[i] = shown.encode()
            plain.append((shown, i))
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary needs a piece for every byte")
    inner = [s for s, _ in plain if " " in s.lstrip(" ")]
    if inner:
        raise ValueError(f"pieces with a word mark after other characters: {inner[:3]}")
    lengths = np.array([len(s) for s, _ in plain])
    keys = np.zeros(len(plain), np.uint64)
    for length in np.unique(lengths):
        keys[lengths == length] = _prefix_hashes(_codes([s for s, _ in plain if len(s) == length]))[-1]
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces share a hash")
    scores = np.array([p.get_score(i) for _, i in plain])
    scores = np.where(scores > -1e8, scores, scores[scores > -1e8].min())  # runs of blanks have no real score
    hit = np.zeros(1 << _SLOTS, bool)
    hit[_slots(keys)] = True
    pairs = sorted({ord(a) << 32 | ord(b) for s, _ in plain for a, b in zip(s, s[1:], strict=False)})
    held = {c for s, _ in plain if len(s) > 1 for c in s}
    return Vocabulary(tuple(texts), keys[order], np.array([i for _, i in plain], np.int32)[order], scores[order], byte_ids, hit, np.array(pairs, np.uint64),
                      max(len(s) for s, _ in plain), "".join(c for c in "\n\t\r\v\f" if c not in held))


def best_paths(words: list[str], v: Vocabulary) -> list[bytes]:
    """Piece ids of words of one length, as little-endian int32."""
    codes = _codes(words)
    length, n = codes.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    step, piece = np.ones((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
    for end, size, rows, at in v.arcs(codes):
        if size == 1:
            # an unknown character is kept as its code point below zero
            best[end], piece[end] = best[end - 1] + v.unknown, -1 - codes[end - 1].astype(np.int32)
            best[end, rows], piece[end, rows] = best[end - 1, rows] + v.scores[at], v.ids[at]
            continue
        score = best[end - size, rows] + v.scores[at]
        won = score >= best[end, rows]
        rows = rows[won]
        best[end, rows], step[end, rows], piece[end, rows] = score[won], size, v.ids[at[won]]
    path, used = np.zeros((n, length), np.int32), np.zeros((n, length), bool)
    at, rows = np.full(n, length), np.arange(n)
    for k in range(length - 1, -1, -1):
        path[rows, k], used[rows, k] = piece[at, rows], True
        at = at - step[at, rows]
        live = at > 0
        if not live.all():
            rows, at = rows[live], at[live]
        if not len(rows):
            break
    flat, edges = path[used], np.concatenate(([0], np.cumsum(used.sum(1)))) * 4
    blob = flat.tobytes()
    out = [blob[i:j] for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
    for i in np.flatnonzero(((path < 0) & used).any(1)).tolist():
        ids = np.frombuffer(out[i], np.int32).tolist()
        out[i] = np.concatenate([[x] if x >= 0 else v.byte_ids[list(chr(-1 - x).encode())] for x in ids]).astype(np.int32).tobytes()
    return out


class Encoder:
    """Encodes texts; remembers the pieces of words it has seen."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        alone = re.escape(v.alone)
        self.cut = re.compile(f" *[^ {alone}]+| +|[{alone}]+" if alone else " *[^ ]+| +").findall

    def learn(self, words: set[str]) -> None:
        parts = {w: (self.v.split(w) if len(w) > _LONG else [w]) for w in words}
        new: dict[int, list[str]] = {}
        for p in {p for ps in parts.values() for p in ps}:
            new.setdefault(len(p), []).append(p)
        done: dict[str, bytes] = {}
        for length, group in new.items():
            rows = max(1, (1 << 19) // (length + 1))
            for i in range(0, len(group), rows):
                part = group[i : i + rows]
                done.update(zip(part, best_paths(part, self.v), strict=True))
        self.known.update((w, b"".join(done[p] for p in ps)) for w, ps in parts.items())

    def __call__(self, texts: list[str | None]) -> list[bytes | None]:
        """Little-endian int32 ids of each text; null for null."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        words = set().union(*cut)
        if len(self.known) + len(words) > _CACHE:
            self.known.clear()
        self.learn(words - self.known.keys())
        get = self.known.__getitem__
        return [None if t is None else b"".join(map(get, ws)) for t, ws in zip(texts, cut, strict=True)]


_encoders: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """The encoder of this vocabulary in this worker, kept from task to task."""
    key = hash(v.texts)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(v)
    return _encoders[key]


def _id_lists(blobs: list[bytes | None]) -> pa.Array:
    sizes = np.array([0, *[len(b or b"") // 4 for b in blobs]])
    values = pa.array(np.frombuffer(b"".join(b or b"" for b in blobs), np.int32))
    missing = pa.array([b is None for b in blobs])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), values, mask=missing)


def _parts(batch: pa.RecordBatch, at: int, weight: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of bounded size in column ``at``."""
    import pyarrow.compute as pc

    length = pc.binary_length if pa.types.is_string(batch.schema.field(at).type) else pc.list_value_length
    run = np.cumsum(length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // weight
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:], strict=False):
        yield batch.slice(i, j - i)


class Decoder:
    def __init__(self, texts: tuple[bytes, ...]):
        self.texts = texts

    def __call__(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.texts))]
        raw = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", name: str = "pieces", restored: str | None = None, model_file: str = MODEL_FILE) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in ``name`` (array<int>,
    replacing a column of that name). A blank is put before a text; blanks are
    kept. Characters that no piece covers become byte pieces, so every text
    comes back from ``decode``. Null gives null, an empty text no ids.

    With ``restored`` the ids are decoded again where they are made, and the
    column of this name tells whether that gave the text (true for null)."""
    ship_package(docs.sparkSession)
    v = load_vocabulary(model_file)

    def make(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
        encoder, decoder = _encoder(v), Decoder(v.texts)
        for batch in batches:
            for part in _parts(batch, at, _CHARS):
                texts = part.column(at).to_pylist()
                blobs = encoder(texts)
                same = [pa.array([b is None or decoder(np.frombuffer(b, np.int32)) == t for b, t in zip(blobs, texts, strict=True)], pa.bool_())] if restored else []
                yield part, _id_lists(blobs), *same

    return append_columns(docs, text, {name: T.ArrayType(T.IntegerType())} | ({restored: T.BooleanType()} if restored else {}), make)


def decode(docs: DataFrame, pieces: str = "pieces", name: str = "decoded", model_file: str = MODEL_FILE) -> DataFrame:
    """``docs`` with the text of the ids in ``pieces`` in ``name`` (replacing a
    column of that name). Control ids, null ids and ids outside the vocabulary
    give nothing; broken UTF-8 gives replacement characters. Null gives null."""
    ship_package(docs.sparkSession)
    decoder = Decoder(load_vocabulary(model_file).texts)

    def make(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
        for batch in batches:
            for part in _parts(batch, at, _CHARS):
                lists = part.column(at)
                offsets = lists.offsets.to_numpy()  # they point into the values of the whole batch
                values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False)
                offsets = offsets - offsets[0]  # null ids have become one outside the vocabulary
                out = [decoder(values[offsets[k] : offsets[k + 1]]) if ok else None for k, ok in enumerate(lists.is_valid().to_pylist())]
                yield part, pa.array(out, pa.string())

    return append_columns(docs, pieces, {name: T.StringType()}, make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, restored="restored")
    return out.select("doc_id", F.greatest(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "restored")
