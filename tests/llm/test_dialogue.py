"""Conversation repair against all edits, whole strings and odd rows."""

from __future__ import annotations

import hashlib
import heapq
import re

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from flowspark.llm import dialogue as D

ROLES = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}


def plain(rows):
    """(cost, audit) of rows (initial, fault): cheapest first, then ASCII, over all edit strings."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if (i, out[-1:]) in seen:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        seen.add((i, out[-1:]))
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[out[-1:]]
        for c in "ua":
            if c in ok:
                heapq.heappush(heap, (cost + 3, audit + "I", i, out + c))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                if initial in ok:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, out + initial))
                for c in "ua":
                    if c in ok:
                        heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, out + c))


row = st.tuples(st.sampled_from("suat"), st.sampled_from(["", "", "truncated", "blank", "duplicate"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(row, max_size=14), st.integers(1, 14))
def test_all_edits(rows, size):
    parts = [[(c, f, 1) for c, f in rows[i : i + size]] for i in range(0, len(rows), size)]
    tables = [[w for e in ((0,) if i == 0 else (0, 1, 2, 3)) for w in D.cheapest(p, e)] for i, p in enumerate(parts)]
    cost, audit = D.joined(tables)
    assert (cost, audit) == plain(rows)
    writer, out = D.Rewriter(audit), []
    for c, _ in rows:
        out += writer.row(ROLES[c], "x")
    out += writer.end()
    assert writer.at == len(audit) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["K", "R", "D", "IK", "IIR"]), min_size=9, max_size=9), min_size=2, max_size=5))
def test_order_of_strings(paths):
    for collide in (False, True):
        store, ends = D.Audits(), []
        for path in paths:
            node = 0
            for part in path:
                node = store.add(node, part)
                if collide:
                    store.hash[node] = 7
            ends.append(node)
        for a in ends:
            for b in ends:
                assert store.text(store.least(a, b)) == min(store.text(a), store.text(b))
        head, rest, new = store.settle(ends)
        assert [head + rest.text(n) for n in new] == [store.text(n) for n in ends]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def repaired(spark, rows):
    return {r["conv_id"]: r.asDict() for r in D.repair(rows_of(spark, rows)).collect()}


def digest(*lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_faults_and_result(spark):
    got = repaired(spark, [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 4, "user", "cut"), (1, 5, "assistant", " \t"),
        (2, None, "system", "Be."), (2, 0, "tool", "Out?"), (3, 3, "assistant", "Alone!"), (4, None, None, None), (None, 7, "user", "No id."), (None, 8, "assistant", "Ok. \n"),
        (5, 0, "", "x."),
    ])
    assert got[1] == {"conv_id": 1, "gaps": 2, "blank": 1, "duplicate": 1, "truncated": 1, "illegal": 1, "cost": 12, "audit": "KKDDD", "repaired_sha256": digest("user:Hi.", "assistant:Yes.")}
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"], got[2]["illegal"]) == (0, 6, "KIR", 1)
    assert got[2]["repaired_sha256"] == digest("system:Be.", "user:", "assistant:Out?")
    assert (got[3]["audit"], got[3]["cost"], got[3]["repaired_sha256"]) == ("IK", 3, digest("user:", "assistant:Alone!"))
    assert (got[4]["audit"], got[4]["blank"], got[4]["gaps"], got[4]["repaired_sha256"]) == ("D", 1, 0, digest())
    assert (got[None]["audit"], got[None]["cost"]) == ("KK", 0)
    assert (got[5]["audit"], got[5]["cost"]) == ("D", 4)


def test_long_conversation_in_many_pieces(spark, monkeypatch):
    import random

    r = random.Random(5)
    rows = [(9, i // 2, r.choice(list(ROLES.values())), r.choice([f"t{i}.", f"t{i}", "", "same.", "same."])) for i in range(400)]
    rows += [(10, 0, "user", "again.")] * 300
    want = D.repair(rows_of(spark, rows).coalesce(1)).orderBy("conv_id").collect()
    monkeypatch.setattr(D, "_PIECE", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert D.repair(rows_of(spark, rows).repartition(5)).orderBy("conv_id").collect() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert want[1]["duplicate"] == 299 and want[1]["illegal"] == 299 and want[1]["audit"] in ("K" + "D" * 299 + "I",)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "What?")]
    out = D.repaired_rows(rows_of(spark, rows)).orderBy("conv_id", "place").collect()
    audit = repaired(spark, rows)[1]
    assert digest(*[f"{r['role']}:{r['text']}" for r in out]) == audit["repaired_sha256"]
    assert "".join(r["edit"] for r in out) == audit["audit"].replace("D", "")


def test_empty_table_and_extra_columns(spark):
    assert D.repair(rows_of(spark, [])).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "k", 9)], "id long, t long, r string, x string, copies long, key string, cost long")
    assert D.repair(df, "id", "t", "r", "x").first()["audit"] == "KI"


@pytest.mark.parametrize("rows", [None, [(1, 1, "user", "A."), (1, None, "user", "a"), (None, None, None, None), (None, 2, "x", "B!"), (2, 3, "assistant", "é…"), (2, 3, "assistant", "é…"), (2, 4, "system", "z\x0b.")]])
def test_sql(spark, tmp_path, rows):
    folder = "/root/testdata/sf0.001"
    if rows:
        folder = str(tmp_path)
        rows_of(spark, rows).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    cur = con.execute(D.ORACLE)
    names = [d[0] for d in cur.description]
    got = D.query(spark, folder).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))
