"""Language models against dictionaries, held-out accuracy and odd rows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowspark.llm import language as L

SF = "/root/testdata/sf0.01"


def grams(texts, order):
    fold, out, has = L.Folder(), Counter(), np.zeros(len(texts), bool)
    for _, _, place, rows in L.ngrams(texts, order, L._MULTIPLIERS[0], fold, has):
        for row, n in zip(rows.tolist(), np.bincount(place).tolist()):
            out[tuple(row)] += n
    return out


def model_of(texts_by_lang, order=3):
    found = {x: grams(t, order) for x, t in sorted(texts_by_lang.items())}
    symbols = len({g[-1] for f in found.values() for g in f}) + 1
    parts = [L.kneser_ney(np.array(list(f)), np.array(list(f.values())), symbols, L._MULTIPLIERS[0]) for f in found.values()]
    return L._calibrated(L.Model(L.Config(order=order), list(found), L._MULTIPLIERS[0], symbols, *([p[i] for p in parts] for i in range(3))), np.zeros(0, int), np.zeros(0), np.zeros((0, len(found))))


class Plain:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, counts, order, symbols):
        self.symbols, self.levels = symbols, {order: dict(counts)}
        raw = {order: Counter(counts)}
        for k in range(order - 1, 0, -1):
            raw[k], left = Counter(), Counter()
            for g, n in raw[k + 1].items():
                raw[k][g[1:]] += n
                left[g[1:]] += 1
            self.levels[k] = {g: raw[k][g] if g[0] == L._START else left[g] for g in left}
        self.d, self.total, self.kinds = {}, defaultdict(int), defaultdict(int)
        for k, level in self.levels.items():
            once, twice = (sum(n == m for n in level.values()) for m in (1, 2))
            self.d[k] = min(max(once / (once + 2 * twice), 0.1), 0.95) if once and twice else 0.75
            for g, n in level.items():
                self.total[g[:-1], k] += n
                self.kinds[g[:-1], k] += 1

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / self.symbols
        total = self.total.get((g[:-1], k), 0)
        if not total:
            return lower
        return max(self.levels[k].get(g, 0) - self.d[k], 0) / total + self.d[k] * self.kinds[g[:-1], k] / total * lower


TEXTS = {"en": ["The cat sat on the mat.", "a cat, a hat; that bat", "the the"], "xx": ["zug um zug geht es gut", "es zieht – sehr!"]}


def test_same_as_dictionaries():
    model = model_of(TEXTS)
    probe = "the cat geht; ñ on zu"
    rows = np.array(list(grams([probe], 3)))
    got = L.log_probabilities(rows, model)
    for i, x in enumerate(model.langs):
        plain = Plain(grams(TEXTS[x], 3), 3, model.symbols)
        want = [math.log(plain.p(tuple(r))) for r in rows.tolist()]
        np.testing.assert_allclose(got[:, i], want, rtol=1e-5)


def test_probabilities_sum_to_one():
    model = model_of(TEXTS)
    seen = sorted({g[-1] for t in TEXTS.values() for g in grams(t, 3)})
    contexts = [(L._START, L._START), (L._START, ord("t")), (ord("t"), ord("h")), (ord("q"), ord("q")), (32, ord("z"))]
    for c in contexts:
        rows = np.array([(*c, x) for x in [*seen, 0x10FFFF]])  # the last stands for all others
        np.testing.assert_allclose(np.exp(L.log_probabilities(rows, model)).sum(0), 1, rtol=1e-5)


def test_folding_and_slices(monkeypatch):
    fold, has = L.Folder(), np.zeros(4, bool)
    texts = ["  Ünï\t\t42 É! ", None, "", "12 ..."]
    got = {i: "".join(map(chr, x[2:])) for i, x in L._folded(texts, 3, fold, has)}
    assert got == {0: "ünï é ", 3: ""} and has.tolist() == [True, False, False, False]
    model = model_of(TEXTS)
    long = ["the cat sat.  On - the mat " * 50, "x"]
    want = L.entropies(long, model, L.Folder())
    monkeypatch.setattr(L, "_SLICE", 13)
    monkeypatch.setattr(L, "_BLOCK", 40)
    for a, b in zip(L.entropies(long, model, L.Folder()), want):
        np.testing.assert_allclose(a, b, rtol=1e-12)


def test_texts_do_not_hang_on_neighbours():
    model = model_of(TEXTS)
    alone = [L.predict([t], model, L.Folder()) for t in ("the cat", "es zieht", None, "9")]
    for i, got in enumerate(zip(*L.predict(["the cat", "es zieht", None, "9"], model, L.Folder()))):
        assert got == tuple(x[0] for x in alone[i])


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == docs.count() and 0 < len(held) < len(out)
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert held.score.between(0, 1).all() and held.rejected.mean() < 0.1
    right = (held.lang == held.lang_pred) & (held.score > 0.9)
    assert right.sum() >= 0.9 * (held.score > 0.9).sum()


def test_rejects_other_languages(spark):
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    _, _, low, rejected = L.predict(["zażółć gęślą jaźń, wszystko płynie " * 5, "привет мир " * 20], model, L.Folder())
    assert rejected.all() and (low > model.means.max()).all()


def test_odd_rows(spark, awkward, nothing):
    model = model_of(TEXTS)
    clash = awkward.selectExpr("*", "1 as score", "'q' as lang_pred")
    out = L.with_language(clash, model).toPandas()
    assert len(out) == awkward.count() and sorted(out.columns) == sorted([*awkward.columns, *L.NEW])
    no_letter = out.text.isna() | out.text.fillna("").str.strip().eq("")
    assert (out.lang_pred[no_letter] == "und").all() and (out.score[no_letter] == 0).all() and out.rejected[no_letter].all()
    assert out.lang_pred[~no_letter].isin(["en", "xx"]).all()
    assert L.with_language(nothing, model).count() == 0


@pytest.mark.parametrize("rows", [[], [(5, None, "en"), (6, "text", None)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.langs == [] and [r["lang_pred"] for r in L.with_language(docs, model).collect()] == ["und"] * len(rows)
