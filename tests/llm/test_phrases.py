"""Phrase mining against plain counting and the guarantees of its summaries."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flowspark.llm import phrases as P

SF = "/root/testdata/sf0.001"


def plain(rows, least, top=P.TOP):
    """(lang, rank, phrase, a, l, r, n, score) by dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found, gone = {}, set()
    for key, a in f.items():
        if len(key) > 2 and a >= least:
            lang, w = key[0], key[1:]
            found[key] = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
            gone |= {(lang, *w[i : i + m]) for m in range(2, len(w)) for i in range(len(w) - m + 1) if a >= f[lang, *w[i : i + m]]}
    out = []
    for lang in n:
        mine = sorted((-found[k][0], -f[k], " ".join(k[1:]).encode(), k) for k in found if k[0] == lang and k not in gone)
        for rank, (_, _, _, k) in enumerate(mine[:top], 1):
            cut = found[k][1] + 1
            out.append((lang, rank, " ".join(k[1:]), f[k], f[k[:cut]], f[lang, *k[cut:]], n[lang], found[k][0]))
    return sorted(out)


def mined(spark, rows, least=3, top=P.TOP):
    df = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in P.collocations(df, least, top).collect())


def test_plain_counting(spark):
    rng = np.random.default_rng(1)
    words = ["The", "cat", "sat", "on", "Mat,", "dog.", "ran", "a\tb", "é", "x!y", "\x01", "big\nred"]
    rows = [(["en", "de", None][i % 3], " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(120)]
    rows += [("en", "new york city hall opens new york city hall")] * 5 + [("en", None), ("en", ""), ("en", " \t"), (None, "A B a b a b. a b"), ("fr", "x y")]
    want = plain(rows, 3)
    assert len(want) > 50 and mined(spark, rows) == want
    assert mined(spark, rows, top=4) == plain(rows, 3, 4)


def test_texts_cut_into_slices_and_blocks(spark, monkeypatch):
    rows = [("en", "one two three four five six seven, " * 40), ("de", "ab cd ef " * 50)]
    want = plain(rows, 3)
    monkeypatch.setattr(P, "_SLICE", 37)
    assert [w for p in P.tokens(rows[0][1]) for w in p if w not in (b"", b"\n")] == [w.encode() for w in re.findall("[a-z]+", rows[0][1])]
    table, found = P.Vocabulary("en", None), Counter()
    monkeypatch.setattr(P, "_BLOCK", 11)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([rows[0][1]])], names=["lang", "text"])
    for table, ids, known in P.runs(iter([batch]), None):
        for n, at, _ in P.ngrams(table, ids, known, None, range(2, 6)):
            found.update(b" ".join(table.words[w] for w in ids[i : i + n]).decode() for i in at)
    seen = Counter(" ".join(p.split()[i : i + k]) for p in rows[0][1].split(",") for k in range(2, 6) for i in range(len(p.split()) - k + 1))
    assert found == seen
    assert mined(spark, rows) == want


def test_no_rows_and_clashing_columns(spark):
    assert mined(spark, []) == []
    df = spark.createDataFrame([("en", "a b", 1, "z")] * 3, "lang string, text string, f long, phrase string")
    assert [tuple(r) for r in P.collocations(df, 3).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    df = spark.range(1).selectExpr(f"{big}L a", f"{big * 7}L n", f"{big}L l", f"{big + 1}L r")
    assert df.select(P._score(df.a, df.n, df.l, df.r)).first()[0] == 1000 * big * big * 7 // (big * (big + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=8), st.integers(2, 12))
def test_every_frequent_key_survives(tasks, least):
    total, parts = Counter(), []
    for t in tasks:
        keys, n = np.unique(np.array(t, np.uint64), return_counts=True)
        parts.append((keys, n.astype(np.int64)))
        total.update(t)
    left = P.survivors(parts, least)
    assert {k for k, c in total.items() if c >= least} <= set(left.tolist())
    assert len(left) <= sum(total.values()) // least + 1


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, np.uint64) >> np.uint64(16) << np.uint64(16))
    assert (P._unpacked(P._packed(keys)) == keys).all()


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for least in ("100", "4"):
        want = con.execute(P.ORACLE.replace("f >= 100", f"f >= {least}")).fetchall()
        got = P.collocations(spark.read.parquet(f"{SF}/documents.parquet"), int(least))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 20
