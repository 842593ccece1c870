"""Emission distributions: log-likelihoods of counts (with a scale) and weighted maximum-likelihood fits.

A fit takes a table of distinct values with weights, which the engine aggregates on the executors; it is small
whatever the number of bins, as counts are capped and scales are discrete. Differences keep both samples' counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

# Floors of log-likelihoods, and the limits of the dispersion searches.
FLOOR, GAUSS_FLOOR, SKELLAM_LIMIT = -40.0, -30.0, 120
ALPHA_SINGLE, ALPHA_PAIR = (1e-20, 100.0), (1e-5, 10.0)

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, float)).astype(float)


@dataclass
class Weighted:
    """Distinct values (k, or a and b with k = a - b), their scale, and how much each weighs."""

    k: np.ndarray
    s: np.ndarray
    w: np.ndarray
    a: np.ndarray | None = None
    b: np.ndarray | None = None


@dataclass
class Distribution:
    """Named parameters and the two operations on them."""

    params: list[float] = field(default_factory=list)
    name = ""

    def log_likelihood(self, k: np.ndarray, s: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def fitted(self, x: Weighted) -> Distribution:
        raise NotImplementedError

    @property
    def mean(self) -> float:
        return self.params[0]

    def __str__(self) -> str:
        return " ".join([self.name, *(repr(float(p)) for p in self.params)])


class Exponential(Distribution):
    name = "exp"

    def log_likelihood(self, k, s):
        t = self.params[0] * s
        return -np.log(t) - k / t

    def fitted(self, x):
        return Exponential([float((x.w * x.k).sum() / x.w.sum())])


class Poisson(Distribution):
    name = "pois"

    def log_likelihood(self, k, s):
        rate = self.params[0] * s
        return np.where(rate > 0, -rate + k * np.log(np.maximum(rate, 1e-300)) - lgamma(k + 1), FLOOR)

    def fitted(self, x):
        return Poisson([max(float((x.w * x.k).sum() / (x.w * x.s).sum()), 1e-10)])


def _bisect_alpha(mu: float, k: np.ndarray, s: np.ndarray, w: np.ndarray, limits: tuple[float, float]) -> float:
    """The dispersion where the score of the negative binomial with mean mu s vanishes."""
    top = int(k.max()) if len(k) else 0
    counts = np.round(k).astype(int)
    at_least = np.bincount(counts, w, minlength=top + 2)[::-1].cumsum()[::-1]  # weight of counts >= j
    j = np.arange(top)
    m = mu * s

    def slope(a: float) -> float:
        # derivative of sum ln(1 + a j) + k ln m - (k + 1 / a) ln(1 + a m) by a; by series where a m is small
        x = a * m
        tail = (at_least[1 : top + 1] * j / (1 + a * j)).sum() if top else 0.0
        curve = np.where(x < 1e-4, m * m * (0.5 - 2 * x / 3), (np.log1p(x) - x / (1 + x)) / (a * a if a * a > 0 else 1.0))
        return float(tail + (w * (curve - m * k / (1 + x))).sum())

    low, high = limits
    while (high - low) / high > 1e-10:
        mid = (low + high) / 2
        if slope(mid) > 0:
            low = mid
        else:
            high = mid
        if high <= 1e-15:
            break
    return (low + high) / 2


def _negative_binomial(mu: float, alpha: float, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For whole counts, in a form that stays exact as alpha goes to 0, where it is the Poisson distribution."""
    m = mu * s
    top = int(k.max(initial=0))
    rising = np.concatenate([[0.0], np.cumsum(np.log1p(alpha * np.arange(top)))])
    x = alpha * m
    with np.errstate(divide="ignore", invalid="ignore"):
        out = rising[np.round(k).astype(int)] - lgamma(k + 1) + k * np.log(m) - k * np.log1p(x) - np.where(x > 1e-12, m * np.log1p(x) / x, m)
    return np.where(np.isfinite(out), out, FLOOR)


class NegativeBinomial(Distribution):
    """Mean mu and dispersion alpha: variance mu + alpha mu^2."""

    name = "nbd"

    def log_likelihood(self, k, s):
        return _negative_binomial(*self.params, k, s)

    def fitted(self, x):
        mu = max(float((x.w * x.k).sum() / (x.w * x.s).sum()), 1e-10)
        return NegativeBinomial([mu, _bisect_alpha(mu, x.k, x.s, x.w, ALPHA_SINGLE)])


def log_bessel_i(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln I_n(x) by its power series in log space."""
    n, x = np.broadcast_arrays(np.abs(np.asarray(n, float)), np.asarray(x, float))
    most = int(max(40, 2 * x.max(initial=0.0) + 40))
    m = np.arange(most)[:, None]
    half = np.log(np.maximum(x.ravel(), 1e-300) / 2)
    flat = n.ravel()
    t = (2 * m + flat) * half - lgamma(m + 1) - lgamma(m + flat + 1)
    top = t.max(axis=0)
    return (top + np.log(np.exp(t - top).sum(axis=0))).reshape(n.shape)


class Skellam(Distribution):
    name = "skel"

    @property
    def mean(self):
        return self.params[0] - self.params[1]

    def log_likelihood(self, k, s):
        u, v = self.params
        out = -(u + v) * s + k / 2 * math.log(u / v) + log_bessel_i(k, 2 * s * math.sqrt(u * v))
        return np.where((np.abs(k) > SKELLAM_LIMIT) | ~np.isfinite(out), FLOOR, out)

    def fitted(self, x):
        n = (x.w * x.s).sum()
        return Skellam([max(float((x.w * x.a).sum() / n), 1e-10), max(float((x.w * x.b).sum() / n), 1e-10)])


class Gaussian(Distribution):
    """Mean m s and standard deviation sigma s."""

    name = "gauss"

    def log_likelihood(self, k, s):
        sd = self.params[1] * s
        return np.maximum(-0.5 * ((k - self.params[0] * s) / sd) ** 2 - np.log(sd * math.sqrt(2 * math.pi)), GAUSS_FLOOR)

    def fitted(self, x):
        y, w = x.k / x.s, x.w
        total = w.sum()
        m = (w * y).sum() / total
        v = (w * (y - m) ** 2).sum() / total * total**2 / max(total**2 - (w * w).sum(), 1e-12)
        return Gaussian([float(m), max(math.sqrt(v), 1e-6)])


class NegativeBinomialDifference(Distribution):
    """The difference of two negative binomials: mu and alpha of either."""

    name = "nbdiff"

    @property
    def mean(self):
        return self.params[0] - self.params[2]

    def log_likelihood(self, k, s):
        m1, a1, m2, a2 = self.params
        k, s = np.broadcast_arrays(np.asarray(k, float), np.asarray(s, float))
        out = np.full(k.shape, FLOOR)
        for scale in np.unique(s):
            at = np.flatnonzero(s == scale)
            wide = lambda m, a: int(m * scale + 40 * math.sqrt(m * scale + a * (m * scale) ** 2) + 60)
            n = np.arange(max(wide(m1, a1), wide(m2, a2)) + int(np.abs(k[at]).max()) + 1)
            one = _negative_binomial(m1, a1, n.astype(float), np.full(len(n), scale))
            two = _negative_binomial(m2, a2, n.astype(float), np.full(len(n), scale))
            for v in np.unique(k[at]):
                v_ = int(round(v))
                t = one[v_:] + two[: len(n) - v_] if v_ >= 0 else one[: len(n) + v_] + two[-v_:]
                out[at[k[at] == v]] = t.max() + math.log(np.exp(t - t.max()).sum())
        return np.where(np.isfinite(out), np.maximum(out, -700.0), FLOOR)

    def fitted(self, x):
        n = (x.w * x.s).sum()
        out = []
        for c in (x.a, x.b):
            mu = max(float((x.w * c).sum() / n), 1e-10)
            out += [mu, _bisect_alpha(mu, c, x.s, x.w, ALPHA_PAIR)]
        return NegativeBinomialDifference(out)

    def with_slopes(self, x: Weighted) -> tuple[float, np.ndarray]:
        """The weighted log-likelihood of the differences, and its derivatives by the logarithms of the four parameters."""
        m1, a1, m2, a2 = self.params
        total, slopes = 0.0, np.zeros(4)
        for scale in np.unique(x.s):
            at = np.flatnonzero(x.s == scale)
            values, place = np.unique(np.round(x.k[at]).astype(int), return_inverse=True)
            weights = np.bincount(place, x.w[at])
            wide = lambda m, a: int(m * scale + 40 * math.sqrt(m * scale + a * (m * scale) ** 2) + 60)
            n = np.arange(max(wide(m1, a1), wide(m2, a2)) + int(np.abs(values).max(initial=0)) + 1).astype(float)
            ones = np.full(len(n), scale)
            one, two = _negative_binomial(m1, a1, n, ones), _negative_binomial(m2, a2, n, ones)
            by = [*_slopes(m1 * scale, a1, n), *_slopes(m2 * scale, a2, n)]  # by ln mu and ln alpha of either
            for v, w in zip(values.tolist(), weights.tolist(), strict=True):
                first, second = (slice(v, None), slice(0, len(n) - v)) if v >= 0 else (slice(0, len(n) + v), slice(-v, None))
                t = one[first] + two[second]
                top = t.max()
                share = np.exp(t - top)
                sum_ = share.sum()
                total += w * (top + math.log(sum_))
                slopes += w / sum_ * np.array([share @ by[0][first], share @ by[1][first], share @ by[2][second], share @ by[3][second]])
        return total, slopes

    def refined(self, x: Weighted, tolerance: float = 1e-9, most: int = 60) -> NegativeBinomialDifference:
        """From these parameters up the likelihood of the differences themselves, which the marginal fits don't see; it never falls.

        Quasi-Newton steps on the logarithms of the parameters with halving, until a step gains less than `tolerance` of the likelihood. Dispersions keep to the pair's limits.
        """
        low = np.log([1e-10, ALPHA_PAIR[0], 1e-10, ALPHA_PAIR[0]])
        high = np.log([1e10, ALPHA_PAIR[1], 1e10, ALPHA_PAIR[1]])
        at = np.clip(np.log(np.maximum(self.params, 1e-300)), low, high)
        own = lambda v: NegativeBinomialDifference(np.exp(v).tolist())
        value, slope = own(at).with_slopes(x)
        shape = np.eye(4) / max(1.0, float(np.abs(slope).max()))
        for _ in range(most):
            step = shape @ slope
            if step @ slope <= 0:
                shape = np.eye(4) / max(1.0, float(np.abs(slope).max()))
                step = shape @ slope
            step *= min(1.0, 1.0 / max(float(np.abs(step).max()), 1e-300))  # at most e-fold
            while True:
                new = np.clip(at + step, low, high)
                got, there = own(new).with_slopes(x)
                if got >= value or np.abs(step).max() < 1e-12:
                    break
                step /= 2
            if got < value:
                break
            moved, change, gain = new - at, slope - there, got - value
            at, value, slope = new, got, there
            if gain <= tolerance * abs(value):
                break
            if (curve := moved @ change) > 1e-300:
                left = np.eye(4) - np.outer(moved, change) / curve
                shape = left @ shape @ left.T + np.outer(moved, moved) / curve
        return own(at)


def _slopes(m: float, alpha: float, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of ln p(n) of the negative binomial by ln of its mean m and ln of alpha."""
    j = np.arange(len(n) - 1)
    rising = np.concatenate([[0.0], np.cumsum(j / (1 + alpha * j))])
    z = alpha * m
    curve = m * m * (0.5 - 2 * z / 3) if z < 1e-4 else (math.log1p(z) - z / (1 + z)) / alpha**2
    return n - m * (alpha * n + 1) / (1 + z), alpha * (rising + curve - n * m / (1 + z))


KINDS = {d.name: d for d in (Exponential, Poisson, NegativeBinomial, Skellam, Gaussian, NegativeBinomialDifference)}


def make(text: str) -> Distribution:
    """From a name, with parameters after blanks or commas."""
    name, *params = text.replace(",", " ").split()
    if name not in KINDS:
        raise ValueError(f"unknown distribution: {name}")
    return KINDS[name]([float(p) for p in params])
