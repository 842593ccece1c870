"""Ordered statistics: half-mass splits, percentiles, weighted moments, p-value adjustment, kernel smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that an ordered column is cut into, and rows from which on that is done; a range is sorted by one task.
RANGES, LEAST_ROWS = 512, 200_000


def _ranges(rows: DataFrame, value: str, n: int) -> Column:
    """The number of a value's range, by approximate quantiles: rising with the value, about RANGES of them for many rows."""
    cuts = rows.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES)) if n > LEAST_ROWS else []
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.lit(cuts), lambda c: c < F.col(value))) if cuts else F.lit(0)


def running(rows: DataFrame, value: str, of: str, name: str, how=F.sum, desc: bool = False, inclusive: bool = True) -> DataFrame:
    """Adds name: how (sum or max) of `of` over the rows with a smaller value (desc: larger), and the row's own if inclusive; values are distinct.

    Ranges of the value run side by side; a window over one row a range gives each what lies before it.
    """
    far = rows.withColumn("_g", _ranges(rows, value, rows.count()))
    order = (lambda c: F.desc(c)) if desc else F.col
    past = Window.orderBy(order("_g")).rowsBetween(Window.unboundedPreceding, -1)
    carry = far.groupBy("_g").agg(how(of).alias("_c")).withColumn("_c", how("_c").over(past))
    within = Window.partitionBy("_g").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    met = far.join(F.broadcast(carry), "_g").withColumn(name, how(of).over(within))
    joined = F.greatest(name, "_c") if how is F.max else F.when(F.col(name).isNull(), F.col("_c")).otherwise(F.col(name) + F.coalesce("_c", F.lit(0)))
    return met.withColumn(name, joined).drop("_g", "_c")


def _mass_before(values: DataFrame, value: str, order: str) -> DataFrame:
    """value, order, _before: sum of |value| of the rows ahead in (value desc, order desc), and _total.

    Sums per distinct value come first: the ordered windows run over those, not over rows.
    """
    per = values.groupBy(value).agg(F.sum(F.abs(value)).alias("_m"))
    total = per.agg(F.sum("_m").alias("_total"))
    per = running(per, value, "_m", "_ahead", desc=True, inclusive=False).withColumn("_ahead", F.coalesce("_ahead", F.lit(0.0)))
    at = F.row_number().over(Window.partitionBy(value).orderBy(F.col(order).desc())) - 1
    return values.join(per.drop("_m"), value).crossJoin(F.broadcast(total)).withColumn("_before", F.col("_ahead") + at * F.abs(value)).drop("_ahead")


def half_mass_split(values: DataFrame, value: str, order: str) -> DataFrame:
    """Adds top: 1 while the mass of larger values (then later rows) is below half the total, rounded up."""
    return _mass_before(values, value, order).withColumn("top", (F.col("_before") < F.ceil(F.col("_total") / 2)).cast("int")).drop("_before", "_total")


def third_mass_split(values: DataFrame, value: str, order: str) -> DataFrame:
    """Adds part 0, 1, 2: rows by falling value until a third of the mass each; the sum begins anew with part 1."""
    m = _mass_before(values, value, order)
    third = F.ceil(F.col("_total") / 3)
    first = m.agg(F.min(F.when(F.col("_before") >= third, F.col("_before"))).alias("_first"))
    return m.crossJoin(F.broadcast(first)).withColumn("part", F.when(F.col("_before") < third, 0).when(F.col("_before") - F.col("_first") < third, 1).otherwise(2)).drop("_before", "_total", "_first")


def percentile_cutoff(values: DataFrame, value: str, share: float = 0.05) -> float | None:
    """Element floor(n (1 - share)), counted from 0, of the sorted values; None without values.

    Values are counted by range until the range that holds the element has few different ones; only those are sorted.
    """
    left = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    n = left.agg(F.sum("_n")).first()[0]
    if not n:
        return None
    at = min(int(n * (1 - share) + 1e-9), n - 1)
    while True:
        grouped = left.withColumn("_g", _ranges(left, value, left.count()))
        for r in grouped.groupBy("_g").agg(F.sum("_n").alias("n"), F.count("*").alias("k")).orderBy("_g").collect():
            if at < r.n:
                break
            at -= r.n
        left = grouped.filter(F.col("_g") == r["_g"]).drop("_g")
        if r.k <= LEAST_ROWS or r["_g"] == 0 and grouped.select("_g").distinct().count() == 1:
            break
    upto = F.sum("_n").over(Window.orderBy(value))
    return left.withColumn("_u", upto).filter(F.col("_u") > at).agg(F.min(value)).first()[0]


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def weighted_variance(x: Column, w: Column) -> Column:
    """The sample variance with weights: second moment about the weighted mean, times W^2 / (W^2 - sum w^2)."""
    total = F.sum(w)
    return (F.sum(w * x * x) / total - F.pow(F.sum(w * x) / total, F.lit(2.0))) * (total * total) / (total * total - F.sum(w * w))


def bh_adjust(values: DataFrame, p: str, standard: bool = False) -> DataFrame:
    """Adds adjusted, at most 1; ties share the rank of their last.

    The running maximum, by rising p, of p n / rank; standard: the smallest of p n / rank from a row on (Benjamini and Hochberg).
    """
    per = running(values.groupBy(p).agg(F.count("*").alias("_k")), p, "_k", "_rank").crossJoin(F.broadcast(values.agg(F.count(p).alias("_n"))))
    per = per.withColumn("_q", F.col(p) * F.col("_n") / F.col("_rank"))
    if standard:
        per = running(per.withColumn("_q", -F.col("_q")), p, "_q", "_m", how=F.max, desc=True).withColumn("_m", -F.col("_m"))
    else:
        per = running(per, p, "_q", "_m", how=F.max)
    return values.join(per.select(p, F.least("_m", F.lit(1.0)).alias("adjusted")), p)


def fdr_cutoff(values: DataFrame, p: str, alpha: float) -> float | None:
    """The largest p below the first that reaches alpha rank / n; null if the smallest already does."""
    per = running(values.groupBy(p).agg(F.count("*").alias("_k")), p, "_k", "_rank").withColumn("_rank", F.col("_rank") - F.col("_k") + 1)
    n = values.count()
    bad = per.filter(F.col(p) >= alpha * F.col("_rank") / n).agg(F.min(p)).first()[0]
    good = per if bad is None else per.filter(F.col(p) < bad)
    return good.agg(F.max(p)).first()[0]


def epanechnikov(u: Column) -> Column:
    return 0.75 * (1 - u * u)


def smooth_points(points: DataFrame, targets: DataFrame, bandwidth: float, key: str = "chrom") -> DataFrame:
    """(key, x, smooth): kernel mean of the points' y in [x - bandwidth, x + bandwidth) at every target; targets without points are left out.

    A range join by cells of one bandwidth: a target meets its own cell and the two beside it.
    """
    cell = F.floor(F.col("x") / bandwidth)
    p = points.select(F.col(key).alias("_k"), F.col("x").alias("_px"), F.col("y").alias("_py"), cell.alias("_c"))
    t = targets.select(key, "x", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    met = t.join(p, (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_c"))).filter((F.col("_px") >= F.col("x") - bandwidth) & (F.col("_px") < F.col("x") + bandwidth))
    weight = epanechnikov((F.col("_px") - F.col("x")) / bandwidth)
    out = met.groupBy(key, "x").agg(F.sum(weight * F.col("_py")).alias("_s"), F.sum(weight).alias("_w"))
    return out.filter("_w > 0").select(key, "x", (F.col("_s") / F.col("_w")).alias("smooth"))


def smooth_index(series: DataFrame, bandwidth: int, key: str = "chrom", order: str = "bin", value: str = "y") -> DataFrame:
    """Adds smooth: kernel mean over the rows from `bandwidth` before to `bandwidth` - 1 after."""
    w = Window.partitionBy(key).orderBy(order)
    terms = [(epanechnikov(F.lit(j / bandwidth)), j) for j in range(-bandwidth, bandwidth)]
    num = sum((k * F.coalesce(F.lead(value, j).over(w) if j >= 0 else F.lag(value, -j).over(w), F.lit(0.0)) for k, j in terms), F.lit(0.0))
    den = sum((F.when((F.lead(value, j) if j >= 0 else F.lag(value, -j)).over(w).isNotNull(), k).otherwise(0.0) for k, j in terms), F.lit(0.0))
    return series.withColumn("smooth", F.when(den > 0, num / den))
