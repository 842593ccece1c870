"""Bin sizes from the number of reads and the observable axis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reference sizes and exponents (smooth, not smooth), reads and observable axis they hold for, limits.
SIZES = {True: 600.0, False: 400.0}
WATERMAN = {True: 1 / 6, False: 1 / 4}
HIDEAKI = {True: 1 / 3, False: 1 / 2}
READS, AXIS, LEAST, MOST = 1e7, 2287968180.0, 100, 3000


def rounded_size(x: float, step: int) -> int:
    """The multiple of step nearest to x; halves go down."""
    return math.ceil(x / step - 0.5) * step


def rounded(x: Column, step: int) -> Column:
    return (F.ceil(x / step - 0.5) * step).cast("long")


def _by_power(bins: DataFrame, step: int, exponent: float, smooth: bool, count: str) -> int:
    r = bins.agg(F.sum(count).alias("n"), F.sum("scale").alias("s")).first()
    if not r.n:
        return MOST
    size = SIZES[smooth] / (r.n / READS * AXIS / (step * r.s)) ** exponent
    return min(max(rounded_size(size, step), LEAST), MOST)


def waterman(bins: DataFrame, step: int, smooth: bool = True, count: str = "reads") -> int:
    return _by_power(bins, step, WATERMAN[smooth], smooth, count)


def hideaki(bins: DataFrame, step: int, smooth: bool = True, count: str = "reads") -> int:
    return _by_power(bins, step, HIDEAKI[smooth], smooth, count)


def corrected_counts(bins: DataFrame, step: int, size: int, max_dead: float, count: str = "reads", seed: int = 1) -> DataFrame:
    """Counts of re-binned, observable bins over their scale, rounded up with the probability of the fraction over 1.1, by a seeded hash."""
    n = size // step
    big = bins.groupBy("chrom", F.floor(F.col("bin") / n).alias("g")).agg(F.sum(count).alias("k"), F.avg("scale").alias("s"), F.count("*").alias("n"))
    x = F.col("k") / F.col("s")
    draw = F.pmod(F.xxhash64("chrom", "g", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) * 1.1
    return big.filter((F.col("n") == n) & (F.col("s") > 1 - max_dead)).select("chrom", "g", F.when(draw < x - F.floor(x), F.ceil(x)).otherwise(F.floor(x)).cast("double").alias("k"))


def cost(bins: DataFrame, step: int, size: int, max_dead: float, count: str = "reads") -> float:
    """(2 mean - variance) / size ** 2 of the corrected counts."""
    r = corrected_counts(bins, step, size, max_dead, count).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    return math.inf if r.m is None else (2 * r.m - r.v) / size**2


def hideaki_empirical(bins: DataFrame, step: int, max_dead: float = 0.5, count: str = "reads") -> int:
    """The size in the limits with the lowest cost, by ternary search; a probe is two aggregations over the bins."""
    low, high, known = LEAST, MOST, {}

    def f(size: int) -> float:
        if size not in known:
            known[size] = cost(bins, step, size, max_dead, count)
        return known[size]

    while high - low > step:
        third = (high - low) / 3
        a, b = max(step, rounded_size(low + third, step)), max(step, rounded_size(high - third, step))
        if f(a) <= f(b):
            high = b if b < high else high - step
        else:
            low = a if a > low else low + step
    return low if f(low) <= f(high) else high
