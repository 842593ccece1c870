"""Domains from decoded bins: runs, confidence labels, islands, filters by the state's distribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import Distribution

# Labels by state, of two and of three.
LABELS = {2: ("ENRICHED", "BACKGROUND"), 3: ("SAMPLE-I-ENRICHED", "NO-DIFFERENCE", "SAMPLE-II-ENRICHED")}
UNCONFIDENT = "UNCONFIDENT"


def _order(key: str = "region") -> Window:
    return Window.partitionBy(key).orderBy("bin")


def runs(bins: DataFrame, state: str = "state", name: str = "run") -> DataFrame:
    """Numbers maximal stretches of one state in each region."""
    w = _order()
    new = F.coalesce(F.lag(state).over(w) != F.col(state), F.lit(True))
    return bins.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def label(bins: DataFrame, score: str, cutoff: float, undefined: int, states: int = 2) -> DataFrame:
    """Adds label and local, the score for what is finally said of a bin.

    A run of one state is confident if its best score reaches the cutoff. A stretch of unconfident bins longer than `undefined`
    positions stays so; a shorter one takes the neighbours' label where both sides agree, else its majority's (two states: the
    first if it has half; three: the most, lowest first). Where the label is another than the state, local is what is left of the score.
    """
    marked = runs(bins)
    sure = marked.withColumn("_sure", F.max(score).over(Window.partitionBy("region", "run")) >= cutoff)
    firm = runs(sure.withColumn("_f", F.when(F.col("_sure"), F.col("state")).otherwise(-1)), "_f", "stretch")
    votes = [F.sum((F.col("state") == i).cast("int")).alias(f"v{i}") for i in range(states)]
    stretch = firm.groupBy("region", "stretch", "_f").agg(F.min("start").alias("s"), F.max("end").alias("e"), *votes)
    w = Window.partitionBy("region").orderBy("stretch")
    left, right = F.lag("_f").over(w), F.lead("_f").over(w)
    majority = F.lit(states - 1)
    if states == 2:
        majority = F.when(2 * F.col("v0") >= F.col("v0") + F.col("v1"), 0).otherwise(1)
    else:
        for i in range(states - 1, -1, -1):
            majority = F.when(F.col(f"v{i}") == F.greatest(*[f"v{j}" for j in range(states)]), i).otherwise(majority)
    said = F.when(F.col("_f") >= 0, F.col("_f")).when(F.col("e") - F.col("s") > undefined, -1).when(left == right, left).otherwise(majority)
    named = stretch.withColumn("label", said).select("region", "stretch", "label")
    rest = (1 - F.col(score)) / (states - 1)
    out = firm.join(named, ["region", "stretch"])
    return out.withColumn("local", F.when((F.col("label") < 0) | (F.col("label") == F.col("state")), F.col(score)).otherwise(rest)).drop("_sure", "_f", "stretch", "run")


def build(labelled: DataFrame, counts: Column | str = "reads") -> DataFrame:
    """Runs of one label as (chrom, start, end, label, mean, score, n, region)."""
    k = F.col(counts) if isinstance(counts, str) else counts
    return (
        runs(labelled, "label")
        .groupBy("region", "run", "chrom", "label")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum(k) / F.sum("scale")).alias("mean"), F.sum("local").alias("score"), F.count("*").alias("n"))
        .drop("run")
    )


def cumulative(d: Distribution, low: int, high: int) -> np.ndarray:
    """F(low) ... F(high) of a distribution at scale 1, summed from where it begins."""
    begin = min(low, -2000) if low < 0 else 0
    k = np.arange(begin, high + 1, dtype=float)
    return np.minimum(np.cumsum(np.exp(d.log_likelihood(k, np.ones(len(k))))), 1.0)[low - begin :]


def _table(d: Distribution, low: int, high: int, at: Column) -> Column:
    """F at a whole number, looked up in a literal table of the counts' bounded range."""
    values = F.lit(cumulative(d, low, high).tolist())
    return F.element_at(values, (F.least(F.greatest(at, F.lit(low)), F.lit(high)) - low + 1).cast("int"))


def filter_two(domains: DataFrame, foreground: Distribution, cutoff: float, low: int, high: int) -> DataFrame:
    """Enriched domains whose mean is not in the lower `cutoff` of the foreground; counts lie between low and high."""
    kept = domains.filter("label = 0").withColumn("_f", _table(foreground, low, high, F.floor("mean").cast("int")))
    return kept.filter(F.col("_f") >= cutoff).drop("_f").withColumn("state", F.lit(LABELS[2][0]))


def filter_three(domains: DataFrame, foreground: Distribution, background: Distribution, cutoff: float, low: int, high: int) -> DataFrame:
    """Differences of three states: a domain on the other side of both means changes sides, then must lie well within its state's distribution."""
    up, down = F.ceil("mean").cast("int"), F.floor("mean").cast("int")
    side = F.when((F.col("label") == 0) & (up < background.mean), 2).when((F.col("label") == 2) & (down > foreground.mean), 0).otherwise(F.col("label"))
    kept = domains.withColumn("label", side).filter("label IN (0, 2)")
    kept = kept.withColumn("_f", F.when(F.col("label") == 0, _table(foreground, low, high, down)).otherwise(1 - _table(background, low, high, up)))
    names = F.when(F.col("label") == 0, LABELS[3][0]).otherwise(LABELS[3][2])
    return kept.filter(F.col("_f") >= cutoff).drop("_f").withColumn("state", names)
