"""The fit of differences: derivatives by finite differences, and a likelihood that never falls."""

import numpy as np
import pytest

from loomseg.functions.distributions import Weighted, make


def _sample(seed, n=4000):
    r = np.random.default_rng(seed)
    draw = lambda mu, a: r.negative_binomial(1 / a, 1 / (1 + a * mu * s)).astype(float)
    s = r.choice([0.5, 1.0], n)
    a, b = draw(6, 0.5), draw(2, 0.2)
    rows, w = np.unique(np.stack([a, b, s]), axis=1, return_counts=True)
    return Weighted(rows[0] - rows[1], rows[2], w.astype(float), rows[0], rows[1])


@pytest.mark.parametrize("params", [[5.0, 0.4, 2.0, 0.3], [0.3, 1e-5, 9.0, 2.0], [2.0, 3.0, 2.0, 1e-4]])
def test_derivatives(params):
    x = _sample(1, 200)
    d = make("nbdiff " + " ".join(map(str, params)))
    value, slopes = d.with_slopes(x)
    assert value == pytest.approx((x.w * d.log_likelihood(x.k, x.s)).sum())
    for i in range(4):
        sides = []
        for h in (1e-5, -1e-5):
            p = list(params)
            p[i] *= np.exp(h)
            sides.append(make("nbdiff " + " ".join(map(repr, map(float, p)))).with_slopes(x)[0])
        assert slopes[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("seed", [2, 3])
def test_likelihood_never_falls(seed):
    x = _sample(seed)
    first = make("nbdiff 1 1 1 1").fitted(x)
    better = first.refined(x)
    assert better.with_slopes(x)[0] >= first.with_slopes(x)[0]
    assert np.abs(better.with_slopes(x)[1]).max() < 1e-3 * x.w.sum()
    # from anywhere it comes close to the best
    other = make("nbdiff 1 1 1 1").refined(x, most=300)
    assert other.with_slopes(x)[0] == pytest.approx(better.with_slopes(x)[0], rel=1e-4)


def test_it_stands_where_nothing_differs():
    x = Weighted(np.zeros(1), np.ones(1), np.array([5.0]), np.zeros(1), np.zeros(1))
    d = make("nbdiff 1 1 1 1").fitted(x).refined(x)
    assert np.isfinite(d.params).all()
