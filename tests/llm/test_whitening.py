"""Whitening against plain numpy and exact integers."""

import math
import random

import numpy as np
import pytest

from loomseg.llm import whitening
from loomseg.llm.whitening import fit_whitening, whiten

VECS = "vec_id long, embedding array<float>"


def _brute(rows, most):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in ok]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d))
    ok = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in ok if len(v) == dims]
    n = len(ok)
    sums = [sum(x[d] for _, x in ok) for d in range(dims)]
    mean = np.array([s / n for s in sums])
    centred = np.array([x for _, x in ok], float) - mean
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    w = centred @ v[:, :most] / np.sqrt(e[:most])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in ok]
    return [i for i, _ in ok], n, deviation, w, e[:most] / np.trace(cov)


@pytest.mark.parametrize("tile,block", [(256, 4 << 20), (3, 640), (4, 8)])
def test_equals_numpy(spark, monkeypatch, tile, block):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROW_BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(10, 10)) * np.arange(1, 11)
    v = (rng.normal(size=(300, 10)) @ base / 30 + 0.3).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(300, None), (301, [None] * 10), (302, [float("nan")] * 10), (303, [1.0] * 9 + [float("inf")]), (304, []), (305, [1.0, 2.0]), (306, rows[5][1]), (None, rows[6][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], VECS + ", n int, component string").repartition(5)
    ids, n, deviation, w, explained = _brute(rows, 8)
    got = whiten(frame, fit_whitening(frame), 8).collect()
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(r.deviation for r in by[1]) == sorted(deviation)
    for c, rs in by.items():
        assert rs[0].explained == pytest.approx(explained[c - 1], rel=1e-9)
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in rs)
        want = sorted((-1 if i is None else i, x) for i, x in zip(ids, w[:, c - 1]))
        flip = 1 if mine[1][1] * want[1][1] > 0 else -1
        assert [flip * x for _, x in mine] == pytest.approx([x for _, x in want], abs=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_no_variance_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [0.5, -0.25, float(i == 3)]) for i in range(4)], VECS)
    got = whiten(same, fit_whitening(same), 8).collect()
    assert len(got) == 12 and all((r.whitened is None) == (r.component > 1) for r in got)
    one = spark.createDataFrame([(1, [0.5, 0.1])], VECS)
    assert [(r.deviation, r.whitened, r.explained) for r in whiten(one, fit_whitening(one)).collect()] == [(0, None, 0.0)] * 2
    for rows in ([], [(1, None)], [(1, [])]):
        none = spark.createDataFrame(rows, VECS)
        assert whiten(none, fit_whitening(none)).count() == 0


def test_large_entries_stay_exact():
    rng = random.Random(1)
    x = np.array([[rng.randrange(-(1 << 40), 1 << 40) for _ in range(3)] for _ in range(5)])
    low = [int(s) for s in x.sum(axis=0)]
    exact = [sum((5 * v - s) ** 2 for v, s in zip(r, low)) for r in x.tolist()]
    assert whitening._deviations(x, 5, low) == [d if d < 1 << 63 else None for d in exact]
    small = x >> 20
    low = [int(s) for s in small.sum(axis=0)]
    assert whitening._deviations(small, 5, low) == [sum((5 * v - s) ** 2 for v, s in zip(r, low)) for r in small.tolist()]
