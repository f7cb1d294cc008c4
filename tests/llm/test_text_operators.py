"""Line dedup, mixing, SimHash and piece encoding against brute force and on awkward rows."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
import xxhash

from flowspark.llm import lines, mixing, pieces, registry, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES} == {str(i) for i in range(1, 14)}


def test_lines_by_hand(spark):
    rows = [(i, f"menu \nbody {i}\n\nmenu", "site") for i in range(5)] + [(9, "menu\nalone", "other"), (10, "x\nx", None), (11, None, "site")]
    out = {r["id"]: r for r in lines.line_dedup(spark.createDataFrame(rows, "id long, text string, source string"), ratio=0.5, min_pages=3).collect()}
    assert out[0]["text"] == "body 0\n" and (out[0]["n_lines"], out[0]["n_dropped"]) == (4, 2)
    assert out[9]["text"] == "menu\nalone" and out[10]["text"] == "x\nx"
    assert out[11]["text"] is None and out[11]["n_lines"] == 0


def test_lines_awkward(awkward, nothing):
    out = lines.line_dedup(awkward, ratio=0.1, min_pages=2)
    assert out.columns == [*awkward.columns, "n_lines", "n_dropped"] and out.count() == awkward.count()
    assert [r["n_dropped"] for r in out.where("doc_id = 2").collect()] == [1, 1]
    assert lines.line_dedup(nothing).count() == 0


def test_near_copies_are_one_page(spark):
    """Copies with a line of their own count once; a menu on unlike pages counts on each of them."""
    rng = np.random.default_rng(3)
    words = lambda: " ".join(rng.choice(list("abcdefghijklmnop"), 12))
    base, unlike = [words() for _ in range(30)], []
    for i in range(60):
        unlike.append((i, "\n".join(["menu", "second menu line", *[words() for _ in range(int(rng.integers(8, 30)))]]), "s"))
    family = []
    for i in range(100, 300):
        text = list(base)
        text[int(rng.integers(30))] = words()
        family.append((i, "\n".join(["menu", "second menu line", *text]), "s"))
    docs = spark.createDataFrame([*unlike, *family, *[(i + 1000, t, None) for i, t, _ in unlike]], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["n_dropped"] for r in lines.line_dedup(docs, count_copies=False).collect()}
    assert set(out.values()) == {2} and len(out) == docs.count()
    plain = {r["doc_id"]: r["n_dropped"] for r in lines.line_dedup(docs).collect()}
    assert plain[100] > 20  # what counting every copy does


def test_mix_invariants(documents):
    rows, mix = mixing.mix_sources(documents)
    t = rows.toPandas()
    assert (t.taken <= 2 * t["size"]).all() and (t.groupby("source")["size"].transform("sum") == t.source_size).all()
    per = t.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (np.abs(per.target - per.taken) <= 1).all()
    assert abs(per.target.sum() - 1.5 * t["size"].sum()) < 1e-6
    m = mix.orderBy("finish", "served").toPandas()
    assert m.finish.between(0, 1).all() and (m.served.diff().dropna() > 0).all() and m.served.iloc[-1] == m.words.sum()
    again, _ = mixing.mix_sources(documents.repartition(5))
    assert again.select("doc_id", "taken").exceptAll(rows.select("doc_id", "taken")).count() == 0


def test_mix_budget(documents):
    _, mix = mixing.mix_sources(documents, budget=1000)
    assert mix.agg({"words": "sum"}).first()[0] == 1000


def test_mix_awkward(awkward, nothing):
    rows, _ = mixing.mix_sources(awkward)
    t = rows.toPandas()
    assert len(t) == awkward.count() and (t.taken <= 2 * t["size"]).all() and (t[t["size"] == 0].taken == 0).all()
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns and out.count() > 0
    assert mixing.mix_sources(nothing)[0].count() == 0 and mixing.mixed_documents(nothing).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(documents):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(documents).collect()}
    fps = {r["doc_id"]: _fingerprint(r["text"]) for r in documents.collect()}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == fps
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == _components(ids, links)


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_near_fingerprints_all_link(spark, blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for f in base.tolist():
        chain = f
        for d in (1, 2, 3, 3, 4):  # the last is too far
            chain ^= sum(1 << int(b) for b in rng.choice(64, d, replace=False))
            fps.append(chain)
        fps.append(f)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    got = {r["fp"] % 2**64: r["root"] % 2**64 for r in simhash.link_fingerprints(table, blocks).collect()}
    links = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3]
    want = _components(fps, links)
    group = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert group({f: got.get(f, f) for f in fps}) == group(want)


def test_simhash_awkward(awkward, nothing):
    out = simhash.simhash_groups(awkward)
    t = out.toPandas()
    assert len(t) == awkward.count()
    assert set(t[t.doc_id.isin([3, 4, 5])].component_id) == {3} and set(t[t.doc_id.isin([3, 4, 5])].fp) == {0}
    assert set(t[t.doc_id.isin([1, 2])].component_id) == {1}
    kept = simhash.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 7, 8]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.drop_near_copies(nothing).columns == nothing.columns and simhash.drop_near_copies(nothing).count() == 0
    assert simhash.simhash_groups(nothing).count() == 0


def test_texts_under_one_id_are_rows_of_their_own(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i * 7}" for i in range(40))
    docs = spark.createDataFrame([("x", one), ("x", two), ("x", two), ("y", one), (None, one), (None, None)], "doc_id string, text string")
    kept = [tuple(r) for r in simhash.drop_near_copies(docs).collect()]
    assert sorted(kept, key=repr) == sorted([("x", one), ("x", two), (None, one), (None, None)], key=repr)


def test_pieces_round_trip(documents, awkward, nothing):
    for docs in (documents, awkward):
        out = pieces.decode(pieces.encode(docs))
        assert out.columns == [*docs.columns, "pieces", "decoded"]
        assert out.where("not (decoded <=> text)").count() == 0
        assert pieces.encode(docs, restored="same").where("not same or same is null").count() == 0
    assert pieces.decode(pieces.encode(nothing)).count() == 0


def test_pieces_best_path():
    v = pieces.load_vocabulary()
    at = {v.texts[i].decode(): (s, i) for i, s in zip(v.ids.tolist(), v.scores.tolist(), strict=True)}

    def brute(text):  # best score of every prefix, longer last piece on ties
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = []
            for n in range(1, min(end, v.longest) + 1):
                part = text[end - n : end]
                if part in at or n == 1:
                    score, ids = at.get(part, (v.unknown, None))
                    ids = [ids] if isinstance(ids, int) else v.byte_ids[list(part.encode())].tolist()
                    options.append((best[end - n][0] + score, n, best[end - n][1] + ids))
            score, _, ids = max(options, key=lambda o: (o[0], o[1]))
            best.append((score, ids))
        return best[-1][1]

    texts = ["the quick brown fox", "  two  blanks ", "Ünï▁x\n\nline", "a" * 70, "aaaaaaaabbbbbbbb" * 8, "", "0123456789é"]
    encoder = pieces.Encoder(v)
    for text, got in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == (brute(" " + text) if text else [])


def test_decode_odd_ids(spark):
    out = pieces.decode(spark.createDataFrame([([-5, 10**6, None, 0, 1, 2],), (None,), ([],)], "pieces array<int>")).collect()
    assert [r["decoded"] for r in out] == ["", None, ""]
