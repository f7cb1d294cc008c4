"""Phrase collocation mining with mergeable Misra-Gries summaries.

Words are counted exactly per language. Phrases are then found in two passes.
The first deals every n-gram by its hash to partitions of about equal mass;
each partition merges the tasks' partial counts into a Misra-Gries summary that
holds more counters than the partition's mass divided by the threshold, so that
every n-gram that reaches the threshold keeps one. What survives is marked in a
bit array of fixed size. The second pass counts exactly, as text, the n-grams
whose bit is set; what had only company in its bit falls to the threshold then.

A phrase is frequent only if its words and all its parts are, so the first pass
looks at word pairs between frequent words, then at longer n-grams all of whose
pairs survived. The arrays only save work: as they fill up at larger scales,
more n-grams go through the exact count and the result stays the same.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.llm.common import Scratch

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 1000
BITS = 27  # of the arrays that mark words and n-grams; 16 MB each
_MASS = 1 << 21  # n-gram occurrences a partition gets
_SLICE = 1 << 20  # bytes of a text tokenised at a time
_BLOCK = 1 << 20  # words whose n-grams are made at a time
_FLUSH = 1 << 22  # distinct n-grams a task holds before it gives them away
_WORDS = 1 << 20  # words a task remembers, per table
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + b"\n\n\n\n\n\n\n\n\n ")
_M = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text by slices; a line feed stands between two pieces, and
    empty words are blanks to be passed over."""
    folded = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(folded):
        end = at + _SLICE
        if end < len(folded):
            cuts = [x for x in (folded.find(b" ", end), folded.find(b"\n", end)) if x >= 0]
            end = min(cuts, default=len(folded))
        yield folded[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; its top ``BITS`` bits name it."""
    at = h >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _set(h: np.ndarray, width: int) -> np.ndarray:
    """The block of the array, of 2^width bits, in which all hashes ``h`` lie."""
    at = np.unique((h >> np.uint64(64 - BITS)) & np.uint64((1 << width) - 1)).astype(np.int64)
    out = np.zeros(1 << max(width - 3, 0), np.uint8)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _packed(keys: np.ndarray) -> bytes:
    """The top 48 bits of sorted hashes: all upper halves, which hardly differ, then all lower ones."""
    return (keys >> np.uint64(48)).astype(np.uint16).tobytes() + (keys >> np.uint64(16)).astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint16, n).astype(np.uint64) << np.uint64(48) | np.frombuffer(data, np.uint32, n, 2 * n).astype(np.uint64) << np.uint64(16)


class Vocabulary(dict):
    """Numbers of the words of a language; 0 are blanks, 1 what ends a run:
    line feeds and words that cannot be frequent."""

    def __init__(self, lang: str, frequent: np.ndarray | None):
        super().__init__({b"": 0, b"\n": 1})
        self.words, self.hashes = [b"", b"\n"], np.zeros(1 << 12, np.uint64)
        self.lang, self.frequent = lang, frequent
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if self.frequent is not None and not self.frequent[h >> (67 - BITS)] >> (h >> (64 - BITS) & 7) & 1:
            self[word] = 1
            return 1
        n = self[word] = len(self.words)
        self.words.append(word)
        if n == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(n, np.uint64)))
        self.hashes[n] = h
        return n


def runs(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None) -> Iterator[tuple[Vocabulary, np.ndarray, int]]:
    """Blocks of (vocabulary, word numbers, how many of them the block before
    had already). A block ends anywhere; the next one repeats its last words."""
    tables: dict[str, Vocabulary] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            table, parts, size, known = tables.get(lang) or Vocabulary(lang, frequent), [], 0, 0
            for i in [i for i, x in enumerate(langs) if x == lang]:
                for words in tokens(batch.column(1)[i].as_py()):
                    ids = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
                    parts.append(ids[ids > 0])
                    size += len(parts[-1])
                    if size >= _BLOCK:
                        block = np.concatenate(parts)
                        yield table, block, known
                        parts, size, known = [block[1 - LONGEST :]], LONGEST - 1, LONGEST - 1
                parts.append(np.ones(1, np.int32))
                if len(table) > _WORDS:  # start anew between two texts
                    yield table, np.concatenate(parts), known
                    table, parts, size, known = Vocabulary(lang, frequent), [], 0, 0
            if parts:
                yield table, np.concatenate(parts), known
            tables[lang] = table
            if sum(map(len, tables.values())) > 4 * _WORDS:
                tables = {}


def ngrams(table: Vocabulary, ids: np.ndarray, known: int, pairs: np.ndarray | None, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, place of the first word, hash) of the n-grams inside runs that
    are not among the ``known`` first words; with ``pairs`` only those all of
    whose pairs are marked there."""
    x = table.hashes[ids]
    ok, h = ids > 1, x
    inner = ok
    for n in range(2, sizes.stop):
        if len(ids) < n:
            return
        h = h[:-1] * _M + x[n - 1 :]
        inner = inner[:-1] & ok[n - 1 :]
        if n == 2 and pairs is not None:
            inner[inner] = marked(pairs, _mix(h[inner] + np.uint64(2)))
            linked = inner
        elif n > 2 and pairs is not None:
            inner = inner & linked[n - 2 :]
        if n in sizes:
            at = np.flatnonzero(inner[max(known - n + 1, 0) :]) + max(known - n + 1, 0)
            yield n, at, _mix(h[at] + np.uint64(n))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): every word of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for lang, found in counts.items():
                found.pop(b"", None)
                found.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "f"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = counts.setdefault(lang, Counter())
                for words in tokens(text):
                    mine.update(words)
            if sum(map(len, counts.values())) > _WORDS:
                yield from flush()
        yield from flush()

    return _text(docs).mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Two Misra-Gries summaries (sorted keys, counts) as one of at most
    ``capacity`` counters: counts add up, then the first count beyond the
    capacity is taken from all and what is left of nothing goes."""
    keys, place = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    n = np.bincount(place, np.concatenate((a[1], b[1])), len(keys)).astype(np.int64)
    if len(n) > capacity:
        n = n - np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1]
        keys, n = keys[n > 0], n[n > 0]
    return keys, n


def survivors(parts: list[tuple[np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Keys of the merged summary of all parts. The counters exceed the mass
    divided by ``least``, so no count is lowered by ``least`` or more in all."""
    capacity = sum(int(n.sum()) for _, n in parts) // least + 1
    out = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for part in parts:
        out = merged(out, part, capacity)
    return out[0]


def frequent_ngrams(docs: DataFrame, mass: int, frequent: np.ndarray, pairs: np.ndarray | None, sizes: range, least: int) -> np.ndarray:
    """The array in which every n-gram of ``least`` occurrences has its bit set."""
    width = max(3, BITS - max(0, (max(mass, 1) // _MASS).bit_length()))  # bits of a partition's block of the array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            own = keys >> np.uint64(64 - BITS + width)
            cuts = np.flatnonzero(np.diff(own)) + 1
            for k, c in zip(np.split(keys, cuts), np.split(n.astype(np.uint32), cuts), strict=True):
                if len(k):  # single ones need no count
                    many = c > 1
                    yield int(k[0] >> np.uint64(64 - BITS + width)), _packed(k[~many]), _packed(k[many]), c[many].tobytes()

        def give(rows):
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 256], strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "one", "more", "n"])

        size = 0
        for table, ids, known in runs(batches, frequent):
            for _, _, h in ngrams(table, ids, known, pairs, sizes):
                held.append(h >> np.uint64(16) << np.uint64(16))  # n-grams of equal top bits count together here
                size += len(h)
            if size >= _FLUSH:
                yield from give(list(flush()))
                size = 0
        if held:
            yield from give(list(flush()))

    def summary(table: pa.Table) -> pa.Table:
        parts = []
        for one, more, n in zip(*(table.column(c).to_pylist() for c in ("one", "more", "n")), strict=True):
            keys = np.concatenate((_unpacked(one), _unpacked(more)))
            parts.append((keys, np.concatenate((np.ones(len(one) // 6, np.int64), np.frombuffer(n, np.uint32).astype(np.int64)))))
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([zlib.compress(_set(survivors(parts, least), width).tobytes(), 1)])})

    dealt = _text(docs).mapInArrow(run, "bucket long, one binary, more binary, n binary")
    blocks = dealt.groupBy("bucket").applyInArrow(summary, "bucket long, bits binary").toArrow()
    return _array(zip(blocks["bucket"].to_pylist(), blocks["bits"].to_pylist(), strict=True), width)


def _array(blocks, width: int) -> np.ndarray:
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, bits in blocks:
        out[bucket << (width - 3) : (bucket + 1) << (width - 3)] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out


def _word_array(words: DataFrame, least: int) -> np.ndarray:
    """The array that marks words of ``least`` occurrences, built in blocks."""
    width = BITS - 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, int] = {}
        for batch in batches:
            h = np.fromiter((xxhash.xxh64_intdigest(w, seeds.get(lang) or seeds.setdefault(lang, xxhash.xxh64_intdigest(lang.encode())))
                             for lang, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)), np.uint64, batch.num_rows)
            at = np.unique(h >> np.uint64(64 - BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], names=["word", "bits"])

    rows = words.where(F.col("f") >= least).select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def exact_counts(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, longer: np.ndarray | None, least: int) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids, known in runs(batches, frequent):
            for n, at, h in ngrams(table, ids, known, pairs, range(2, LONGEST + 1)):
                if n > 2:
                    hit = marked(longer, h)
                    at, h = at[hit], h[hit]
                if not len(at):
                    continue
                rows = ids[at[:, None] + np.arange(n)]
                _, first, place, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                if not (rows == rows[first][place]).all():  # two phrases of one hash
                    _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
                text = [b" ".join([table.words[w] for w in row]).decode() for row in rows[first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([table.lang] * len(text), pa.string()), pa.array(text, pa.string()), pa.array(np.full(len(text), n, np.int32)), pa.array(count.astype(np.int64))], names=["lang", "phrase", "size", "f"])

    found = _text(docs).mapInArrow(run, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(share * a * n / (l * r)) in whole numbers of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    over = (wide[0] * F.lit(SHARE).cast("decimal(4,0)")).cast("decimal(19,0)") * wide[1]
    return F.call_function("div", over, wide[2] * wide[3])


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each
    language of ``docs`` (text, lang); without ``top`` of all.

    Phrases are 2 to 5 words inside a piece of text with ``a`` occurrences,
    ``least`` at least, overlaps included. ``l`` and ``r`` are the occurrences
    of the two parts at the weakest cut, ``n`` the language's words. Phrases
    inside a longer one that is as frequent go. Null texts count as empty, a
    null language is ``und``; repeated rows count each; texts are cut nowhere,
    however long; an empty table gives no rows; other columns are not looked
    at. Equal scores go by ``a`` and then the phrase in UTF-8 byte order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    words = scratch.write(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    mass = int(words.agg(F.sum("f")).first()[0] or 0)
    frequent = _word_array(words, least)
    pairs = frequent_ngrams(docs, mass, frequent, None, range(2, 3), least)
    longer = frequent_ngrams(docs, (LONGEST - 2) * mass, frequent, pairs, range(3, LONGEST + 1), least)
    phrases = scratch.write(exact_counts(docs, frequent, pairs, longer, least), "counted")

    split = F.split("phrase", " ")
    known = phrases.select("lang", "phrase", "f").union(words.where(F.col("f") >= least).select("lang", "phrase", "f"))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = (phrases.where(F.col("size") > 2).withColumn("w", split).select("lang", F.explode(inner).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("within")))
    stay = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a")))
    ranked = stay.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w
  from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)),
grams as (
  select lang, size, list_slice(w, i, i + size - 1) as g from (
    select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from pieces, range(1, 6) s(size) where len(w) >= size)),
counted as (select lang, size, g, array_to_string(g, ' ') as phrase, count(*) as f from grams group by lang, size, g),
kept as (select * from counted where f >= 100),
total as (select lang, sum(f)::bigint as n from counted where size = 1 group by lang),
cuts as (
  select c.lang, c.phrase, c.size, c.f as a, k, l.f as l, r.f as r, n, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
  from kept c cross join range(1, 5) t(k) join kept l on l.lang = c.lang and l.size = k and l.g = list_slice(c.g, 1, k)
    join kept r on r.lang = c.lang and r.size = c.size - k and r.g = list_slice(c.g, k + 1, c.size) join total on total.lang = c.lang
  where c.size >= 2 and k < c.size),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select distinct lang, phrase from (
    select x.lang, array_to_string(list_slice(x.g, i, i + m - 1), ' ') as phrase, x.f
    from kept x cross join range(2, 5) a(m) cross join range(1, 5) b(i) where m < x.size and i + m - 1 <= x.size) y
  join (select lang, phrase, f as a from kept) z using (lang, phrase) where y.f >= z.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from weakest w where not exists (select 1 from inside i where i.lang = w.lang and i.phrase = w.phrase)
qualify rank <= 2000
"""
