"""Regions cut into chunks give what whole regions give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseg.functions.distributions import make
from loomseg.operators import hmm
from loomseg.plans import segment

MODELS = {2: segment.fixed_model(["nbd 7 0.5", "nbd 1.5 0.2"], [0.9, 0.95]), 3: segment.fixed_model(["pois 9", "pois 5", "pois 2"], [0.9, 0.8, 0.9])}


def _bins(spark, seed=1):
    """Regions of 1, 37 and 3000 bins that begin anywhere and have gaps, and a region with ties only."""
    rng = np.random.default_rng(seed)
    rows = []
    for name, first, n in (("a", 5, 1), ("b", 59, 37), ("c", 1013, 3000)):
        at = first + np.cumsum(rng.integers(1, 3, n))
        rows += [(name, "x", int(b), float(k), float(s)) for b, k, s in zip(at, rng.poisson(rng.choice([2, 8], n)), rng.choice([0.5, 1.0], n))]
    return spark.createDataFrame(rows, "region string, chunk_name string, bin long, reads double, scale double").orderBy(F.rand(3))


def _regions(bins):
    pdf = bins.toPandas().sort_values(["region", "bin"])
    return {r: p.reset_index(drop=True) for r, p in pdf.groupby("region")}


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
@pytest.mark.parametrize("n", [2, 3])
def test_decode(spark, monkeypatch, n, chunk):
    if chunk == 1 and n == 3:
        pytest.skip("as with two")
    monkeypatch.setattr(hmm, "CHUNK", chunk if chunk > 1 else 3)
    bins, model = _bins(spark), MODELS[n]
    for posterior in (False, True):
        out = hmm.decode(bins, model, "reads", posterior)
        assert out.columns == [*bins.columns, "state", "p", "moves"]
        got = _regions(out)
        for r, p in _regions(bins).items():
            ll = hmm._likelihood(model, p, "reads")
            gamma, _ = hmm.posteriors(model, ll)
            g = got[r]
            assert g["bin"].tolist() == p["bin"].tolist() and g["reads"].tolist() == p["reads"].tolist()
            assert np.stack(g["p"].to_list()) == pytest.approx(gamma, abs=1e-9)
            assert np.stack(g["moves"].to_list()) == pytest.approx(hmm.transition_posteriors(model, ll).reshape(len(p), -1), abs=1e-9)
            assert g["state"].tolist() == (hmm.posterior_decode(gamma) if posterior else hmm.viterbi(model, ll)).tolist()
        out.held.unpersist()


def test_ties_follow_one_path(spark, monkeypatch):
    """Where all paths weigh the same, chunks agree on one: the last state among two."""
    monkeypatch.setattr(hmm, "CHUNK", 5)
    model = hmm.Model([make("pois 3"), make("pois 3")], np.full(2, 0.5), np.full((2, 2), 0.5), np.full(2, hmm.END))
    bins = spark.range(23).select(F.lit("a").alias("region"), F.col("id").alias("bin"), F.lit(2.0).alias("reads"), F.lit(1.0).alias("scale"))
    assert [r.state for r in hmm.decode(bins, model).collect()] == [1] * 23


@pytest.mark.parametrize("n", [2, 3])
def test_expectations(spark, monkeypatch, n):
    bins, model = _bins(spark, 4), MODELS[n]
    want = np.zeros((n, n)), 0.0, {}
    total = 0.0
    for p in _regions(bins).values():
        ll = hmm._likelihood(model, p, "reads")
        gamma, t = hmm.posteriors(model, ll)
        want[0][:] += hmm.transition_posteriors(model, ll).sum(axis=0)
        total += t
        for key, g in zip(zip(p["reads"], p["scale"]), gamma):
            want[2][key] = want[2].get(key, 0) + g
    for chunk in (50, 1 << 16):
        monkeypatch.setattr(hmm, "CHUNK", chunk)
        moves, weighted, got = hmm.expectations(bins, model, "reads", None)
        assert moves == pytest.approx(want[0]) and got == pytest.approx(total)
        for i, w in enumerate(weighted):
            assert {(k, s): v for k, s, v in zip(w.k, w.s, w.w)} == pytest.approx({k: g[i] for k, g in want[2].items()})


def test_no_bins(spark):
    empty = _bins(spark).limit(0)
    assert hmm.decode(empty, MODELS[2]).count() == 0


def test_training_without_bins(spark):
    none = hmm.chunked(_bins(spark).limit(0).withColumns({"a": F.col("reads"), "b": F.col("reads")}))
    for n, model in MODELS.items():
        assert hmm.baum_welch(none, model) == (model, [])
        step, total = hmm.em_step(none, model)
        assert np.isnan(total) and np.isnan(step.trans).all() and all(np.isnan(d.params).all() and type(d) is type(e) for d, e in zip(step.emissions, model.emissions, strict=True))
