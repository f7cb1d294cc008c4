"""Conversation structure repair by a persistent audit DP.

A conversation's role initials must read ``(s?(ua)+)?``. Rows are kept (K),
given another role (R), deleted (D), or empty user/assistant rows are inserted
(I); the cheapest edits win and, among equally cheap ones, those whose initials
in order are ASCII-least.

The DP runs over the four places a valid conversation can be at: before the
first row, after s, after u, after a. The best edits up to a row are a linked
node whose prefix all longer ones share. Every row adds one part to a node (its
inserts, its own letter, the deletions of its repeats), so that live nodes have
equal depth, and no part is the beginning of another one of the same row:
equal costs are settled where the strings first differ, found by
binary lifting over ancestors with rolling hashes. Equal hashes of different
nodes are verified by walking both back to the node they share.

Equal rows of a turn are one row with a count. Rows are range-sorted by
conversation, turn, role and text digest, so a conversation of any size lies in
as many tasks as it needs: each task gives, for every place it may be entered
at, the cheapest edits to every place it can be left at, and the conversation's
pieces are then joined in order by the same linked nodes. Texts move once, in
conversation order, to be hashed as a stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowspark.llm.common import Scratch, col

KEEP, RETELL, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs; CUT_OFF is added for an undeleted truncated row
BLANKS = " \t\n\x0b\x0c\r"
_MOD, _BASE = (1 << 61) - 1, 911_382_323_711
#: place -> (place, inserts) reachable by inserting; places are 0 empty, 1 after s, 2 after u, 3 after a
_INSERTS = {0: ((0, ""), (2, "I"), (3, "II")), 1: ((1, ""), (2, "I"), (3, "II")), 2: ((2, ""), (3, "I")), 3: ((3, ""), (2, "I"))}
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_LEGAL = {"su", "ua", "au"}
_PIECE = 4096  # rows of a conversation that one table of edits covers
_MEMO = 1 << 15


class Audits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self):
        self.part, self.up, self.hash = [""], [[]], [0]

    def add(self, node: int, part: str) -> int:
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.part.append(part)
        self.up.append(up)
        self.hash.append((self.hash[node] * _BASE + zlib.crc32(part.encode()) + len(part) + 1) % _MOD)
        return len(self.part) - 1

    def chain(self, node: int, stop: int = 0) -> list[int]:
        out = []
        while node != stop:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int, stop: int = 0) -> str:
        return "".join(self.part[x] for x in self.chain(node, stop))

    def _same(self, a: int, b: int) -> bool:
        while a != b:
            if self.part[a] != self.part[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def least(self, a: int, b: int) -> int:
        """The ASCII-least of two nodes of equal depth; ``a`` if equal."""
        if a == b:
            return a
        x, y = a, b
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            if self._same(self.up[x][0], self.up[y][0]):
                return a if self.part[x] <= self.part[y] else b
        elif self._same(x, y):
            return a
        return a if self.text(a) <= self.text(b) else b  # hashes collided

    def settle(self, nodes: list[int]) -> tuple[str, Audits, list[int]]:
        """The string that all ``nodes`` begin with, and the rest as a store of its own."""
        chains = [self.chain(n) for n in nodes]
        shared = 0
        while all(len(c) > shared and c[shared] == chains[0][shared] for c in chains):
            shared += 1
        rest, new = Audits(), {}
        ends = []
        for c in chains:
            at = 0
            for n in c[shared:]:
                if n not in new:
                    new[n] = rest.add(at, self.part[n])
                at = new[n]
            ends.append(at)
        return "".join(self.part[n] for n in chains[0][:shared]), rest, ends


Live = dict[int, tuple[int, int]]  # place -> (cost, node)


def _best(store: Audits, offers: Iterable[tuple[int, int, int, str]]) -> Live:
    """The best of (place, cost, node, part) for each place, as new nodes."""
    best: dict[int, tuple[int, int, str]] = {}
    for place, cost, node, part in offers:
        old = best.get(place)
        if old is not None and old[0] <= cost:
            if old[0] < cost or (old[2] <= part if old[1] == node else store.least(old[1], node) == old[1]):
                continue
        best[place] = (cost, node, part)
    return {place: (cost, store.add(node, part)) for place, (cost, node, part) in best.items()}


def _step(store: Audits, live: Live, initial: str, fault: str, copies: int) -> Live:
    """``live`` after a row and its repeats."""
    repeats, more = "D" * (copies - 1), DELETE * (copies - 1)
    offers = [(place, cost + DELETE + more, node, "D" + repeats) for place, (cost, node) in live.items()]
    if fault not in ("blank", "duplicate"):
        more += CUT_OFF if fault == "truncated" else 0
        for place, (cost, node) in live.items():
            for at, inserts in _INSERTS[place]:
                paid = cost + INSERT * len(inserts) + more
                if (at, initial) in _NEXT:
                    offers.append((_NEXT[at, initial], paid + KEEP, node, inserts + "K" + repeats))
                offers.append((_NEXT[at, "a" if at == 2 else "u"], paid + RETELL, node, inserts + "R" + repeats))
    return _best(store, offers)


def cheapest(rows: list[tuple[str, str, int]], entry: int = 0) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of rows (initial, fault, copies)."""
    store = Audits()
    live: Live = {entry: (0, 0)}
    for row in rows:
        live = _step(store, live, *row)
    return [(entry, place, cost, store.text(node)) for place, (cost, node) in sorted(live.items())]


def joined(pieces: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its pieces' tables in order."""
    store, done, live = Audits(), [], {0: (0, 0)}
    for i, ways in enumerate(pieces, 1):
        live = _best(store, ((out, live[entry][0] + cost, live[entry][1], audit) for entry, out, cost, audit in ways if entry in live))
        if i % 16 == 0:  # what all ways share is settled, so only the open ends stay
            text, store, ends = store.settle([n for _, n in live.values()])
            done.append(text)
            live = {place: (cost, n) for (place, (cost, _)), n in zip(live.items(), ends, strict=True)}
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    last = _best(store, ((0, cost + INSERT * len(ends[place]), node, ends[place]) for place, (cost, node) in live.items()))
    return last[0][0], "".join(done) + store.text(last[0][1])


class Rewriter:
    """Applies an audit to a conversation's rows, one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._put("I", "assistant" if self.place == 2 else "user", "")

    def _put(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.at += 1
        self.place = {"s": 1, "u": 2, "a": 3}[role[0]]
        return edit, role, text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        else:
            yield self._put(edit, role if edit == "K" else "assistant" if self.place == 2 else "user", text)

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def plain_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies, key): null roles and texts are one blank."""
    out = rows.select(
        col(conv_id).alias("conv_id"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"),
        F.coalesce(col(text), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    return out.withColumn("key", F.sha2("text", 256))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, initial, fault, copies): equal rows of a turn
    are one; ``fault`` is the first copy's."""
    ink = F.rtrim("text", F.lit(BLANKS))
    own = F.when(ink == "", "blank").when(~F.right(ink, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    folded = rows.groupBy("conv_id", "turn", "role", "key").agg(F.sum("copies").alias("copies"), F.first(own).alias("own"))
    first = folded.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    seen = folded.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")))
    fault = F.when((F.col("own") != "blank") & ~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").otherwise(F.col("own"))
    return seen.select("conv_id", "turn", "role", "key", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "copies")


_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("out", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECES = ("piece long, seq long, ways array<struct<entry:int,out:int,cost:bigint,audit:string>>, first string, last string, "
           "blank long, duplicate long, truncated long, illegal long")


def _piece(rows: list[tuple[str, str, int]], entries: tuple[int, ...], memo: dict) -> dict:
    """The table of a piece and its counts."""
    key = (tuple(rows), entries) if len(rows) <= 64 else None
    if key in memo:
        return memo[key]
    n = dict.fromkeys(_COUNTS, 0)
    for i, (initial, fault, copies) in enumerate(rows):
        if fault == "blank":
            n["blank"] += copies
        else:
            n["truncated"] += fault == "truncated"
            n["duplicate"] += copies - (fault != "duplicate")
        n["illegal"] += copies - 1 + (i > 0 and rows[i - 1][0] + initial not in _LEGAL)
    out = {"ways": [dict(zip(("entry", "out", "cost", "audit"), w, strict=True)) for e in entries for w in cheapest(rows, e)],
           "first": rows[0][0], "last": rows[-1][0], **n}
    if key and len(memo) < _MEMO:
        memo[key] = out
    return out


def _pieces(faults: DataFrame) -> DataFrame:
    """One row for each stretch of a conversation in a sorted task."""
    kind = faults.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        task, seq, started, rows, conv, out, ids = TaskContext.get().partitionId(), 0, False, [], None, [], []

        def close(fresh: bool) -> None:
            nonlocal seq
            out.append({"piece": task, "seq": seq, **_piece(rows, (0,) if fresh else (0, 1, 2, 3), memo)})
            ids.append(conv)
            seq += 1

        def flush(kinds: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(ids, kinds)] + [pa.array([o[n] for o in out], t) for n, t in (
                ("piece", pa.int64()), ("seq", pa.int64()), ("ways", _WAYS), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in _COUNTS))]
            batch = pa.RecordBatch.from_arrays(arrays, names=["conv_id", "piece", "seq", "ways", "first", "last", *_COUNTS])
            out.clear()
            ids.clear()
            return batch

        fresh, kinds = False, None  # a task's first conversation may have begun in the one before
        for batch in batches:
            kinds = batch.schema.field(0).type
            for c, initial, fault, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if started and c != conv:
                    close(fresh)
                    rows, fresh = [], True
                elif len(rows) == _PIECE:
                    close(fresh)
                    rows, fresh = [], False
                started, conv = True, c
                rows.append((initial, fault, copies))
            if len(out) >= 1000:
                yield flush(kinds)
        if rows:
            close(fresh)
        if out:
            yield flush(kinds)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "key")]
    sorted_rows = faults.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "initial", "fault", "copies")
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(_PIECES).fields])
    return sorted_rows.mapInArrow(run, schema)


def _in_order(table: DataFrame, order: list[Column]) -> DataFrame:
    """Each conversation's rows one after the other in one task, as a stream."""
    return table.repartition(F.col("conv_id")).sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


def audits(faults: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of rows with faults."""
    kind = faults.schema["conv_id"].dataType
    names = [*_COUNTS, "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    yield batch.schema.field(0).type, row

        out, ids, stream = [], [], pieces()
        kinds, row = next(stream, (None, None))
        while row is not None:
            conv, counts, last = row[0], dict.fromkeys(_COUNTS, 0), None

            def ways():
                nonlocal row, kinds, last
                while row is not None and row[0] == conv:
                    for name, v in zip(_COUNTS, row[4:], strict=True):
                        counts[name] += v
                    counts["illegal"] += last is not None and last + row[2] not in _LEGAL
                    last = row[3]
                    table = [(w["entry"], w["out"], w["cost"], w["audit"]) for w in row[1]]
                    kinds_next, row = next(stream, (None, None))
                    kinds = kinds_next or kinds
                    yield table

            cost, audit = joined(ways())
            ids.append(conv)
            out.append((*counts.values(), cost, audit))
            if len(out) >= 1000 or row is None:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kinds), *[pa.array([o[i] for o in out], pa.string() if n == "audit" else pa.int64()) for i, n in enumerate(names)]],
                                                 names=["conv_id", *names])
                out, ids = [], []

    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.StringType() if n == "audit" else T.LongType()) for n in names]])
    pieces = _in_order(_pieces(faults), [F.col("piece"), F.col("seq")])
    return pieces.select("conv_id", "ways", "first", "last", *_COUNTS).mapInArrow(run, schema)


def _rewritten(rows: DataFrame, found: DataFrame, digest: bool) -> DataFrame:
    """SHA-256 of each repaired conversation, or its rows."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer, sha, conv, n, kinds = [], None, None, None, 0, None

        def take(new: Iterable[tuple[str, str, str]]) -> None:
            nonlocal n
            for edit, role, text in new:
                if digest:
                    sha.update((("\n" if n else "") + f"{role}:{text}").encode())
                else:
                    out.append((conv, n, edit, role, text))
                n += 1

        def batch_of() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)]
            types = [kinds, pa.string()] if digest else [kinds, pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "place", "edit", "role", "text"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def close() -> None:
            if writer is not None:
                take(writer.end())
                if digest:
                    out.append((conv, sha.hexdigest()))

        for batch in batches:
            kinds = batch.schema.field(0).type
            for c, audit, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if audit is not None:  # a conversation's audit comes before its rows
                    close()
                    writer, sha, conv, n = Rewriter(audit), hashlib.sha256(), c, 0
                else:
                    for _ in range(copies):
                        take(writer.row(role, text))
                if len(out) >= 1000:
                    yield batch_of()
        close()
        if out:
            yield batch_of()

    heads = found.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("key"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", "key")
    stream = _in_order(heads.union(body), [F.col("kind"), F.asc_nulls_first("turn"), F.col("role"), F.col("key")])
    schema = "repaired_sha256 string" if digest else "place long, edit string, role string, text string"
    fields = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(schema).fields])
    return stream.select("conv_id", "audit", "role", "text", "copies").mapInArrow(run, fields)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), ties by role and the SHA-256 of the
    text; ``copies`` repeats a row in place. Null roles and texts count as one
    blank, a null conversation id is an id like any other. A row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated. Repeated
    rows are duplicates. ``gaps`` ignores null turns. Other columns are not
    looked at; an empty table gives no rows. The result holds a letter per row,
    so a conversation's audit is a value of its size.
    """
    return _repair(plain_rows(rows, conv_id, turn, role, text, copies))


def _repair(rows: DataFrame) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "dialogue")
    faults = scratch.write(_faults(rows), "faults")
    found = scratch.write(audits(faults), "audits")
    turns = faults.groupBy(F.col("conv_id").alias("t")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    hashes = _rewritten(rows, found, True).withColumnRenamed("conv_id", "h")
    out = found.join(turns, F.col("conv_id").eqNullSafe(F.col("t"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("h")))
    return out.select("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


def repaired_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), edit
    (K, R or I), role, text. Handles rows as ``repair`` does."""
    plain = plain_rows(rows, conv_id, turn, role, text, copies)
    scratch = Scratch(rows.sparkSession, "dialogue")
    return _rewritten(plain, scratch.write(audits(scratch.write(_faults(plain), "faults")), "audits"), False)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by crc32 of ``conv_id:turn``, and
    how often each row stands there (``copies``)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return rows.withColumn("__kind", kind).where(F.col("__kind") != 0).select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("__kind") == 3, 2).otherwise(1).alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(rows), copies=F.col("copies"))
    ids = rows.select(F.col("conv_id").alias("__id")).distinct()
    out = ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return out.select(F.col("__id").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same edits by a plain recursion that carries whole strings.
ORACLE = r"""
with recursive crc as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 as kind
  from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations)),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from crc, range(2) t(i) where kind <> 0 and (i = 0 or kind = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from damaged),
judged as (
  select *, left(role, 1) as c, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ink,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
flagged as (
  select *, case when ink = '' then 'blank' when again then 'duplicate' when right(ink, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from judged),
moves(p, q, ins) as (values (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
legal(q, c, nxt) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
texts as (
  select m.p, m.q, m.ins, case m.p when 2 then case m.ins when '' then '' else 'assistant:' || chr(10) end
    else case m.ins when '' then '' when 'I' then 'user:' || chr(10) else 'user:' || chr(10) || 'assistant:' || chr(10) end end as added from moves m),
dp as (
  select distinct conv_id, 0::bigint as i, 0 as p, 0::bigint as cost, '' as audit, '' as body from flagged
  union all
  select conv_id, i, p, min(cost), arg_min(audit, (cost, audit)), arg_min(body, (cost, audit)) from (
    select d.conv_id, f.i, d.p, d.cost + 4 as cost, d.audit || 'D' as audit, d.body from dp d join flagged f on d.conv_id is not distinct from f.conv_id and f.i = d.i + 1
    union all
    select d.conv_id, f.i, l.nxt, d.cost + 3 * length(t.ins) + case when f.fault = 'truncated' then 3 else 0 end + case when e.edit = 'R' then 3 else 0 end,
      d.audit || t.ins || e.edit, d.body || t.added || case when e.edit = 'K' then f.role when t.q = 2 then 'assistant' else 'user' end || ':' || f.text || chr(10)
    from dp d join flagged f on d.conv_id is not distinct from f.conv_id and f.i = d.i + 1 and f.fault not in ('blank', 'duplicate')
      join texts t on t.p = d.p cross join (values ('K'), ('R')) e(edit)
      join legal l on l.q = t.q and l.c = case when e.edit = 'K' then f.c when t.q = 2 then 'a' else 'u' end) group by conv_id, i, p),
ended as (
  select d.conv_id, arg_min(d.cost + 3 * length(e.ins), (d.cost + 3 * length(e.ins), d.audit || e.ins)) as cost,
    arg_min(d.audit || e.ins, (d.cost + 3 * length(e.ins), d.audit || e.ins)) as audit, arg_min(d.body || e.added, (d.cost + 3 * length(e.ins), d.audit || e.ins)) as body
  from dp d join (select conv_id, max(i) as n from flagged group by conv_id) m on m.conv_id is not distinct from d.conv_id and m.n = d.i
    join (values (0, '', ''), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 'assistant:' || chr(10)), (3, '', '')) e(p, ins, added) on e.p = d.p
  group by d.conv_id),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal from flagged group by conv_id)
select o.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0)::bigint as blank, coalesce(s.duplicate, 0)::bigint as duplicate,
  coalesce(s.truncated, 0)::bigint as truncated, coalesce(s.illegal, 0)::bigint as illegal, coalesce(e.cost, 0)::bigint as cost,
  coalesce(e.audit, '') as audit, sha256(coalesce(case when e.body = '' then '' else left(e.body, length(e.body) - 1) end, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join sums s on s.conv_id is not distinct from o.conv_id
  left join ended e on e.conv_id is not distinct from o.conv_id
"""
