"""Classifiers by held-out accuracy, language-model scores and passages against brute force."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowspark.llm import common, lm, passages, pieces, quality, toxicity

SF = "/root/testdata/sf0.1"


def _auc(y, score):
    rank = np.argsort(np.argsort(score)) + 1
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.93)])
def test_held_out(spark, module, label, least):
    got = module.query(spark, SF).toPandas()
    mod, fold = module.MOD, module.HELD_OUT
    assert len(got) == 10000 and got.score.between(0, 1).all() and ((got.score >= module.CUT) == got.predicted).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % mod == fold for i in got.doc_id]
    both = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert _auc(both[label].values, both.score.values) >= least


@pytest.mark.parametrize(("module", "add"), [(quality, quality.with_quality), (toxicity, toxicity.with_toxicity)])
def test_classifier_awkward(spark, awkward, nothing, module, add):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(awkward, labels)
    out = add(awkward, model, name="score.x")
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.where("`score.x` is null or `score.x` < 0 or `score.x` > 1").count() == 0
    empty = out.where("doc_id in (3, 4)").select("`score.x`").distinct()
    assert empty.count() == 1  # null scores like empty
    none = module.fit(nothing, labels.limit(0))
    assert {r["s"] for r in add(awkward, none, name="s").select("s").collect()} == {0.5}
    assert add(nothing, model, name="s").count() == 0


def test_toxicity_by_text_ids(spark):
    """Ids as text give the model that the same ids as numbers give."""
    rows = [(i, f"vile slur {i} vile slur" if i % 3 == 0 else f"a calm remark {i} on the garden") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    kept = [{int(r["doc_id"]) for r in toxicity.drop_toxic(d, x).collect()} for d, x in
            ((docs, labels), (named, labels), (named, labels.withColumn("doc_id", labels.doc_id.cast("string"))))]
    assert kept == [{i for i, _ in rows if i % 3}] * 3


def test_long_text_is_seen_whole():
    """A network that looks for one byte finds it anywhere, and slices of characters overlap."""
    c = quality.Config(filters=1)
    taps = np.zeros((4, 256, 1), np.float32)
    taps[0, ord("!"), 0] = 1
    model = quality.Model(c, taps, np.zeros(1, np.float32), np.array([0, 5, -2], np.float32))
    texts = ["x" * 3_000_000 + "!", "!" + "x" * 3_000_000, "x" * 3_000_000, "", None, "!"]
    assert (quality.score_texts(texts, model, model.pairs()) > 0.5).tolist() == [True, True, False, False, False, True]
    t = toxicity.Config(orders=(6,), bits=16)
    word = np.concatenate(list(toxicity.ngram_ids("abcdef", t)))
    for at in (0, toxicity._SLICE - 3, toxicity._SLICE - 1):
        ids = np.concatenate(list(toxicity.ngram_ids("z" * at + "abcdef" + "z" * 50, t)))
        assert set(word[1:2].tolist()) <= set(ids.tolist()) and len(ids) == at + 56 + 2 - 5


def test_base_scores(spark, documents):
    got = {r["doc_id"]: r for r in lm.score_documents(documents, config=lm.Config(frequent=50, rounds=1)).collect()}
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])), None] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    assert got.keys() == tokens.keys()
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(t in counts for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert -1e6 < r["score"] < 0


def test_lattice_brute_force():
    """Every spelling counts: against enumeration of all segmentations."""
    v = pieces.load_vocabulary()
    lattice = lm.start_lattice(v)
    text_of = {v.texts[i].decode(): p for i, p in zip(v.ids.tolist(), lattice.pieces.tolist(), strict=True)}

    def brute(text):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            logs = [text_of.get(text[i:j], lattice._unknown(np.array([ord(text[i])]))[0] if j - i == 1 else -np.inf) for i, j in zip(edges, edges[1:])]
            total += math.exp(sum(logs))
        return math.log(total)

    words = ["the", "cat", "naïve", "𝔘x", "running", "a"]
    got = lattice.log_probabilities([w.encode() for w in words])
    assert np.allclose(got, [brute(" " + w) for w in words])
    # expected uses: one unit of probability is spread over the spellings, whose lengths in characters add up
    uses, byte = np.zeros(len(v.keys)), np.zeros(256)
    for places, codes in lattice.groups([b"running"]):
        lattice.uses(codes, np.ones(len(places)), uses, byte)
    lengths = np.array([len(v.texts[i].decode()) for i in v.ids])
    assert math.isclose((uses * lengths).sum(), len(" running"), rel_tol=1e-9)


def test_refitting_raises_the_likelihood(spark, documents):
    counts = lm.word_counts(documents.withColumn("held_out", documents.doc_id < 0))
    rows = [(r["word"], r["c"]) for r in counts.collect() if r["word"]]
    total = []
    for rounds in (0, 1, 3):
        lattice = lm.fit(counts, lm.Config(rounds=rounds))
        total.append(float(lattice.log_probabilities([bytes(w) for w, _ in rows]) @ np.array([c for _, c in rows])))
    assert total[0] < total[1] < total[2]


def test_lm_awkward(awkward, nothing):
    out = lm.score_documents(awkward, config=lm.Config(rounds=1)).toPandas()
    assert len(out) == awkward.count() and out[out.doc_id.isin([3, 4, 5])].n_tokens.tolist() == [1, 1, 1]
    assert np.isfinite(out[["score", "base_score"]].values).all()
    assert lm.score_documents(nothing, config=lm.Config(rounds=1)).count() == 0


def _words(rng, n):
    return [f"w{int(i)}" for i in rng.integers(0, 5000, n)]


def test_passages_planted(spark, awkward, nothing):
    rng = np.random.default_rng(9)
    passage, rows = _words(rng, 60), []
    for i in range(40):
        own, at = _words(rng, 200), int(rng.integers(0, 200))
        if i < 12:
            part = list(passage)
            if i >= 6:  # fuzzy: a word changed, one left out, one put in
                part[20] = f"x{i}"
                del part[30]
                part.insert(45, f"y{i}")
            own[at:at] = part
        rows.append((i, " ".join(own)))
    rows += [(100, rows[20][1]), (101, rows[20][1].upper()), (102, " ".join(_words(rng, 20)))]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(out.doc_id) | set(out.other_id) == {*range(12), 20, 100, 101}
    texts = {i: t.lower().split() for i, t in rows}
    for r in out.itertuples():
        assert r.similarity >= 0.8 and min(r.last - r.first, r.other_last - r.other_first) >= 50
        if {r.doc_id, r.other_id} <= set(range(6)):
            assert texts[r.doc_id][r.first : r.last] == texts[r.other_id][r.other_first : r.other_last] == passage
    whole = out[out.doc_id.isin([100, 101])]
    assert whole.other_id.tolist() == [20, 20] and (whole["last"] == 200).all()
    assert passages.shared_passages(nothing).count() == 0
    assert passages.shared_passages(awkward).count() == 0


def test_all_long_repeats_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = passages.shared_passages(docs).toPandas()
    where = {}
    for r in docs.collect():
        words = r["text"].lower().split()
        for j in range(len(words) - 50):
            where.setdefault(hash(tuple(words[j : j + 51])), set()).add(r["doc_id"])
    want = set().union(*[w for w in where.values() if len(w) > 1])
    assert want and want <= set(out.doc_id) | set(out.other_id)


def frequent_lines(pairs, others):
    """Texts (2 * i and 2 * i + 1 share three lines of 20 words, each of which also stands in other texts) and their shared runs."""
    rng, rows, more = np.random.default_rng(17), [], []
    for i in range(pairs):
        shared = [_words(rng, 20) for _ in range(3)]
        for _ in range(2):
            own, at = _words(rng, 150), int(rng.integers(0, 150))
            own[at:at] = sum(shared, [])
            rows.append((len(rows), " ".join(own)))
        for line in shared:
            for _ in range(others):
                own, at = _words(rng, 120), int(rng.integers(0, 120))
                own[at:at] = line
                more.append((10_000 + len(more), " ".join(own)))
    return rows + more


def met_pairs(rows, out):
    """(pairs of texts that share a run of 50 words, those that meet over all of it): each other, or one text with it."""
    where, covers = {}, {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    for r in out.itertuples():
        for i, o, a, z in ((r.doc_id, r.other_id, r.first, r.last), (r.other_id, r.doc_id, r.other_first, r.other_last)):
            covers.setdefault(i, []).append((o, a, z))
    want, met = set(), set()
    for places in where.values():
        for (i, p), (j, q) in itertools.combinations(places, 2):
            if i != j:
                want.add((i, j))
                at = [{o for o, a, z in covers.get(k, []) if a <= x and x + 50 <= z} | {k} for k, x in ((i, p), (j, q))]
                if not at[0] & at[1]:
                    met.add((i, j))
    return want, want - met


def test_passages_of_frequent_lines(spark):
    rows = frequent_lines(30, 20)
    want, met = met_pairs(rows, passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas())
    assert len(want) == 30 and met == want


def test_edited_chain_keeps_its_exact_part():
    rng, c = np.random.default_rng(4), passages.Config()
    x, y = rng.integers(0, 60000, 90).astype(np.uint16), rng.integers(0, 60000, 90).astype(np.uint16)
    y[:52], y[77:84] = x[:52], x[77:84]
    a = np.array([0, 16, 32, 47, 77])
    assert [f[:4] for f in passages.passages_of(x, y, a, a, c)] == [(0, 52, 0, 52)]


def test_chains_against_all_subsets():
    rng = np.random.default_rng(2)
    c = passages.Config()
    for _ in range(20):
        a, b = rng.integers(0, 60, 9), rng.integers(0, 60, 9)
        best = max((len(s) - c.gap * ((a[s[-1]] - a[s[0]]) + (b[s[-1]] - b[s[0]])) for n in range(1, 10) for s in map(list, itertools.combinations(np.lexsort((b, a)).tolist(), n))
                    if all(a[i] < a[j] and b[i] < b[j] for i, j in zip(s, s[1:]))), default=0)
        found = passages.chains(a, b, passages.Config(least_anchors=1))[0]
        assert math.isclose(len(found) - c.gap * (a[found[-1]] - a[found[0]] + b[found[-1]] - b[found[0]]), best)


def test_many_parts_of_a_long_chain():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 16, 28 * 1000).astype(np.uint16)
    y = x.copy()
    for i in range(20, len(x), 28):  # 20 equal words, then 8 others
        y[i : i + 8] += 1
    y[14000:14100] = x[14000:14100]
    a = np.arange(0, len(x) - 28, 28)
    got = passages.passages_of(x, y, a, a, passages.Config())
    assert any(s <= 14000 and e >= 14100 for s, e, *_ in got) and len(got) < 5


def test_what_was_shuffled_goes_with_the_write(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "staged", lambda df, *a: seen.append(spark.conf.get(common._CLEANUP)) or df)
    before = spark.conf.get(common._CLEANUP, None)
    common.Scratch(spark, "test").write(spark.range(3), "t")
    assert seen == ["true"] and spark.conf.get(common._CLEANUP, None) == before


def test_seed_pairs_in_bounded_batches():
    rng, c = np.random.default_rng(8), passages.Config()
    texts = rng.permutation(300)
    rows = [[{"place": int(p), "key": int(rng.integers(40)) << 40, "frequent": bool(rng.random() < 0.5), "alone": bool(rng.random() < 0.3)} for p in rng.permutation(3000)[:400]] for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(rows, pa.list_(pa.struct([("place", pa.int32()), ("key", pa.int64()), ("frequent", pa.bool_()), ("alone", pa.bool_())])))], names=["text", "seeds"])
    out = list(passages.near_pairs(batch, c))
    assert len(out) > 1 and max(b.num_rows for b in out) <= passages._SEEDS * c.near
    got = pa.Table.from_batches(out).to_pylist()
    assert [r["text"] for r in got] == sorted(r["text"] for r in got)
    for text, seeds in list(zip(texts, rows, strict=True))[:3]:
        seeds, want = sorted(seeds, key=lambda s: s["place"]), {}
        for i, x in enumerate(seeds):
            for y in seeds[i + 1 :]:
                if y["place"] - x["place"] < c.near and (x["frequent"] or y["frequent"]):
                    want.setdefault((x["key"], y["key"]), []).append(((x["place"], y["place"]), x["alone"] or y["alone"]))
        want = sorted((p, any(a for _, a in v)) for v in want.values() for p in {min(v)[0], max(v)[0]})
        assert sorted((tuple(r["places"]), r["alone"]) for r in got if r["text"] == text) == want


def test_seeds_of_several_texts():
    rng = np.random.default_rng(9)
    for most, c in ((60, passages.Config()), (9, passages.Config(k=2, window=5)), (3, passages.Config())):
        sizes = rng.integers(0, most, 40)
        h = rng.integers(0, 50, sizes.sum()).astype(np.uint64)
        each = [passages.seeds(h[e - n : e], c) for n, e in zip(sizes, np.cumsum(sizes), strict=True)]
        at, key, count = passages.all_seeds(h, sizes, c)
        assert count.tolist() == [len(x) for x, _ in each] and key.tolist() == [k for _, ks in each for k in ks.tolist()]
        assert at.tolist() == [int(x + e - n) for (xs, _), n, e in zip(each, sizes, np.cumsum(sizes), strict=True) for x in xs]


@pytest.mark.parametrize("others", [20, 40])
def test_edited_passages_away_from_centres(spark, others):
    """Lines of 20 words parted by edits: each line also stands in other texts, and the first text of its seeds is one of these."""
    rng, rows, more = np.random.default_rng(23), [], []
    for i in range(20):
        lines = [_words(rng, 20) for _ in range(4)]
        for _ in range(2):
            own, at = _words(rng, 150), int(rng.integers(0, 150))
            own[at:at] = sum([[*line, *_words(rng, 2)] for line in lines], [])
            rows.append((len(rows), " ".join(own)))
        for line in lines:
            for _ in range(others):
                own, at = _words(rng, 120), int(rng.integers(0, 120))
                own[at:at] = line
                more.append((10_000 + len(more), " ".join(own)))
    out = passages.shared_passages(spark.createDataFrame(rows + more, "doc_id long, text string")).toPandas()
    met = {frozenset(p) for p in zip(out.doc_id, out.other_id, strict=True)}
    assert met <= {frozenset((2 * i, 2 * i + 1)) for i in range(20)} and len(met) >= 19  # all pairs of seeds at once give as many
    assert (out.similarity >= 0.8).all()


def crowded_pairs(pairs, others):
    """Texts (2 * i and 2 * i + 1 share two lines of 27 words); other texts hold the two lines too, too far from each other to be 0.8 similar."""
    rng, rows, more = np.random.default_rng(29), [], []

    def text(lines, apart):
        own, at = _words(rng, 120), int(rng.integers(0, 120))
        own[at:at] = [*lines[0], *_words(rng, apart), *lines[1]]
        return " ".join(own)

    for _ in range(pairs):
        lines = [_words(rng, 27) for _ in range(2)]
        rows += [(len(rows) + j, text(lines, 1)) for j in range(2)]
        more += [(10_000 + len(more) + j, text(lines, 20)) for j in range(others)]
    return rows + more


@pytest.mark.parametrize("config", [passages.Config(), passages.Config(hubs=2)])
def test_passages_of_crowded_pairs_of_seeds(spark, monkeypatch, config):
    """Every pair of seeds of the passages stands in more texts than are linked at once."""
    monkeypatch.setattr(passages, "_MEET", 5)
    rows = crowded_pairs(10, 20)
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), config=config).toPandas()
    assert {frozenset(p) for p in zip(out.doc_id, out.other_id, strict=True)} == {frozenset((2 * i, 2 * i + 1)) for i in range(10)}
    assert (out.similarity >= 0.8).all()


def test_places_that_can_meet():
    """As by trying every stretch of 50 words or more around the pair."""
    rng, c = np.random.default_rng(31), passages.Config()
    n, rows = c.around, 60
    left, right = (rng.integers(0, 2, (rows, n)).astype(np.int32) for _ in range(2))
    span = rng.integers(6, 40, rows)
    for side in (left, right):
        for i, row in enumerate(side):
            row[: rng.integers(0, 30)] = 7  # in common
            row[rng.integers(40, n) :] = -1  # the text ends
    found = 0
    for i in range(rows):
        got = passages.can_meet(left, right, span, i, slice(0, rows), c)
        for j in range(rows):
            short, long = min(span[i], span[j]), max(span[i], span[j])
            a, b = (np.r_[0, np.cumsum((s[i] == s[j]) & (s[i] >= 0))] for s in (left, right))
            worth = (a[:, None] + b + short) - c.similarity * (np.add.outer(np.arange(n + 1), np.arange(n + 1)) + long)
            can = worth[np.add.outer(np.arange(n + 1), np.arange(n + 1)) + short >= c.least_words].max()
            assert abs(can) < 1e-2 or got[j] == (can > 0)
            found += got[j]
    assert 0 < found < rows * rows


def test_scores_by_words(spark, documents, monkeypatch):
    """Scores are the sum over a text's words, whatever a worker has forgotten between parts."""
    rows = [(i, " ".join([f"rare{i}", "the", "the", f"Rare{i % 7}"] * (i % 3))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", passages.F.lit(False))
    lattice = lm.start_lattice(pieces.load_vocabulary())
    monkeypatch.setattr(lm, "_KEPT", 5)
    got = {r["doc_id"]: r for r in lm._text_rows(docs, lattice, {b"the": 9, lm.END: 4}, "words").collect()}
    for i, text in rows:
        words, r = text.lower().encode().split(), got[i]
        assert math.isclose(r["score"], (lattice.end + lattice.log_probabilities(words).sum()) / math.log(10), rel_tol=1e-9)
        assert (r["n_tokens"], r["known"]) == (len(words) + 1, 1 + words.count(b"the"))
        assert math.isclose(r["base"], math.log10(5) + words.count(b"the"), rel_tol=1e-9)
        rare = Counter(w for w in words if w != b"the")
        assert dict(zip(r["rare"], r["times"], strict=True)) == {int(np.array(lm.xxhash.xxh64_intdigest(w, 42), np.uint64).view(np.int64)): n for w, n in rare.items()}
