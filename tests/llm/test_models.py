"""Language models against a plain recursion and held-out accuracy; the quality classifier likewise."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseg.llm import langid, quality

SF = "/root/testdata/sf0.01"


def _plain(counts: Counter, order: int):
    """Interpolated Kneser-Ney by dictionaries."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d = {}
    for k, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    sums = {k: Counter() for k in levels}
    kinds = {k: Counter() for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            sums[k][g[:-1]] += v
            kinds[k][g[:-1]] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / langid.ALPHABET
        h = g[:-1]
        if not sums[k][h]:
            return p(g[1:])
        return max(levels[k][g] - d[k], 0) / sums[k][h] + d[k] * kinds[k][h] / sums[k][h] * p(g[1:])

    return p


def test_kneser_ney_by_dictionaries():
    rng = random.Random(1)
    texts = {x: ["".join(rng.choice(a) for _ in range(60)) for _ in range(20)] for x, a in (("one", "abcd e"), ("two", "xyzab "))}
    counts, plain = {}, {}
    for x, ts in texts.items():
        s, n = langid.symbols(ts)
        counts[x] = np.unique(langid.grams(s)[langid.real(n)], return_counts=True)
        c = Counter()
        for t in ts:
            kept = "".join(ch for i, ch in enumerate(t) if ch != " " or (i and t[i - 1] != " "))
            t = "   " + kept + " " * (not kept.endswith(" "))
            c.update(tuple(map(ord, t[i : i + 4])) for i in range(len(t) - 3))
        plain[x] = _plain(c, 4)
    m = langid.build(["one", "two"], counts)
    tests = ["abc dé xy", "zzz", "a b", "qqqq"]
    ce, n = m.score(tests)
    for row, t in enumerate(tests):
        full = "   " + t + " "
        for col, x in enumerate(m.langs):
            want = -sum(math.log2(plain[x](tuple(map(ord, full[i : i + 4])))) for i in range(len(t) + 1)) / (len(t) + 1)
            assert abs(ce[row, col] - want) < 1e-4
        assert n[row] == len(t) + 1


def test_langid_on_held_out(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    models = langid.fit_languages(docs)
    got = langid.identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.01
    rows = {r.doc_id: r for r in langid.identify(odd, models).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (None, 1, 2, 3)) and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(empty, models).count() == 0
    none = langid.fit_languages(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    kept = langid.keep_identified(docs.union(odd.withColumn("score", F.lit("x"))), models)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.filter("text IS NULL OR trim(text) = ''").collect()} == set()


def test_noise_is_rejected(spark):
    models = langid.fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(3)
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)), "".join(rng.choice("qxzjkvw ") for _ in range(500))]
    assert [x[3] for x in models.decide(noise)] == [True, True]


def test_hinge_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 400, 20), 1 if i % 2 else 2)) for i in range(400)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(400)])
    w, b = quality.fit_hinge(rows, np.ones(400), y, np.full(400, 1.0), np.full(400, 0.2))
    assert np.mean([np.sign(w[r].sum() * 0.2 + b) == t for r, t in zip(rows, y, strict=True)]) > 0.99
    assert w[1] > 5 * np.abs(w[10:]).max() / 10 and w[2] < 0


def test_indicators_are_whole_texts():
    flags = np.zeros(1 << quality.BITS, bool)
    text = bytes(random.Random(1).randrange(97, 123) for _ in range(3000))
    whole = quality.indicators(text, flags).tolist()
    quality.PIECE, old = 700, quality.PIECE
    try:
        assert quality.indicators(text, flags).tolist() == whole and not flags.any()
    finally:
        quality.PIECE = old
    assert len(quality.indicators(b"", flags)) == 0


def test_quality_on_held_out(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs.withColumn("held_out", F.lit(1)), model).filter("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.9
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.score_quality(empty, model).count() == 0
    alone = quality.fit_quality(docs, labels.filter("quality = 1"))
    assert all(r.predicted == 1 for r in quality.score_quality(odd, alone).collect())
    assert quality.fit_quality(docs, labels.limit(0)).slope == 0


def test_long_text_is_scored_as_a_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé ,.1 ") for _ in range(n)) for n in (0, 1, 6, 7, 8, 50, 200, 333)]
    want = [langid.symbols([t])[0].tolist() for t in texts]
    k, c = np.unique(np.concatenate([langid.grams(langid.symbols([t])[0]) for t in texts if t.strip()]), return_counts=True)
    models = langid.build(["x"], {"x": (k, c)})
    whole = [models.score([t]) for t in texts]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "LONG", size)
        assert [langid.long_symbols(t).tolist() for t in texts] == want
        for t, (ce, n) in zip(texts, whole, strict=True):
            got = models.score([t])
            assert got[1].tolist() == n.tolist() and got[0] == pytest.approx(ce, rel=1e-5)


def test_calibration_falls_back_to_all_languages():
    n = 3
    models = langid.LanguageModels(["a", "b", "c"], [], [], [], [], np.zeros(n), np.full(n, np.inf), np.zeros(n), np.zeros(n))
    row = lambda lang, k, mean: {"lang": lang, "k": k, "n": 100 * k, "bits": 100 * k * mean, "square": 100 * k * (mean**2 + 0.04), "blocks": 6 * k, "bm": 6 * k * mean, "bs": 6 * k * (mean**2 + 0.25)}
    langid.calibrate(models, [row("a", 9, 2.0), row("b", 2, 3.0)])
    assert models.mean.tolist() == pytest.approx([2.0, 3.0, (9 * 2 + 2 * 3) / 11])
    assert models.noise[0] == pytest.approx(2.0) and models.noise[1] == models.noise[2] > 2.0 and np.isfinite(models.spread).all()
    empty = langid.LanguageModels(["a"], [], [], [], [], np.zeros(1), np.full(1, np.inf), np.zeros(1), np.zeros(1))
    langid.calibrate(empty, [])
    assert empty.mean[0] == np.inf
