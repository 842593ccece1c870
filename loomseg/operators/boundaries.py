"""Boundaries between states, with the posterior support of a single change.

Two changes of state are joined by what lies between them only where the score stays high: an interval around a change is the
run of bins above the cutoff that the change touches, so intervals are islands of an ordered window, and ends meet them by equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .domains import runs
from .hmm import Model, decode
from .stats import percentile_cutoff

SCHEMA = "chrom string, start long, end long, bins int, peak long, peak_score double, p double"


def nearest_change(bins: DataFrame) -> DataFrame:
    """Adds change: the state entered at the change nearest to a bin (a tie goes to the one before), null in a region without one."""
    w = Window.partitionBy("region").orderBy("bin")
    back = Window.partitionBy("region").orderBy(F.desc("bin"))
    marked = bins.withColumn("_i", F.row_number().over(w)).withColumn("_c", F.when(F.lag("state").over(w) != F.col("state"), F.struct(F.col("_i").alias("i"), F.col("state").alias("s"))))
    # what follows is the last seen from the other side: both frames only grow
    both = marked.withColumn("_l", F.last("_c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.last("_c", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    pick = F.when(F.col("_l").isNull() | (F.col("_r.i") - F.col("_i") < F.col("_i") - F.col("_l.i")), F.coalesce("_r", "_l")).otherwise(F.col("_l"))
    return both.withColumn("change", pick["s"]).drop("_i", "_c", "_l", "_r")


def boundary_scores(bins: DataFrame, states: int = 2) -> DataFrame:
    """Adds score: the probability of a move into the state that the nearest change enters; 0 where there is none."""
    n = states
    into = [sum((F.col("moves")[i * n + j] for i in range(n) if i != j), F.lit(0.0)) for j in range(n)]
    score = F.lit(0.0)
    for j in range(n):
        score = F.when(F.col("change") == j, into[j]).otherwise(score)
    return nearest_change(bins).withColumn("score", score)


def shuffled(bins: DataFrame, columns: list[str], seed: int = 1, most: int = 0) -> DataFrame:
    """Permutes the given columns within each region by a seeded hash; most: only the first so many bins, in order of axis and bin."""
    w = Window.partitionBy("region")
    if most:
        before = Window.orderBy("chrom", "_first").rowsBetween(Window.unboundedPreceding, -1)
        per = bins.groupBy("chrom", "region").agg(F.count("*").alias("_n"), F.min("bin").alias("_first")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        bins = bins.join(per.select("region", "_ahead"), "region")
    place = bins.withColumn("_i", F.row_number().over(w.orderBy("bin")))
    if most:
        place = place.filter(F.col("_ahead") + F.col("_i") <= most).drop("_ahead")
    values = place.select("region", F.row_number().over(w.orderBy(F.xxhash64("region", "bin", F.lit(seed)))).alias("_i"), *columns)
    return place.drop(*columns).join(values, ["region", "_i"]).drop("_i")


def control_cutoff(bins: DataFrame, model: Model, k: str, columns: list[str], share: float = 0.05, seed: int = 1, most: int = 0) -> float | None:
    """The score that `share` of the bins exceed once the counts are shuffled; None without bins."""

    moved = decode(shuffled(bins, columns, seed, most).select("region", "bin", k, "scale"), model, k, posterior=True)
    off = [F.element_at("moves", i * model.n + j + 1) for i in range(model.n) for j in range(model.n) if i != j]
    cutoff = percentile_cutoff(moved.select(F.greatest(*off).alias("score")), "score", share)
    moved.held.unpersist()
    return cutoff


def single_change(moves: np.ndarray, a: int, b: int) -> float:
    """Probability of exactly one change, from a to b, along successive transition posteriors (t, n, n).

    The interval is entered by its first bin's joint posterior of a move; after that, a row is what follows from the state before:
    stay at a, move once, stay at b.
    """
    rows = moves / np.maximum(moves.sum(axis=2, keepdims=True), 1e-300)
    stay_a, go, stay_b = rows[:, a, a].copy(), rows[:, a, b].copy(), rows[:, b, b]
    stay_a[0], go[0] = moves[0, a, a], moves[0, a, b]
    before = np.concatenate([[1.0], np.cumprod(stay_a)[:-1]])
    after = np.concatenate([np.cumprod(stay_b[:0:-1])[::-1], [1.0]])
    return float((before * go * after).sum())


def _islands(scored: DataFrame, hot) -> DataFrame:
    """Bins with the number of their island (a maximal run of hot bins, null outside) and of their run of one state."""
    marked = runs(scored.withColumn("_hot", F.coalesce(hot, F.lit(False)).cast("int")), "_hot", "_island")
    return runs(marked.withColumn("_island", F.when(F.col("_hot") == 1, F.col("_island"))), "state", "_run")


def _summaries(islands: DataFrame, states: int) -> DataFrame:
    """(chrom, region, island, first_state, and the columns of a boundary) of every island."""
    one = F.struct("bin", "start", "end", "score", "moves", "state")
    grouped = islands.filter("_island IS NOT NULL").groupBy("chrom", "region", F.col("_island").alias("island")).agg(F.array_sort(F.collect_list(one)).alias("x"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for chrom, region, island, x in zip(pdf["chrom"], pdf["region"], pdf["island"], pdf["x"], strict=True):
                moves = np.stack([np.asarray(r["moves"]) for r in x]).reshape(len(x), states, states)
                own = x[0]["state"]
                p = max(single_change(moves, a, b) for a in range(states) for b in range(states) if a != b and (states == 2 or own in (a, b)))
                peak = max(x, key=lambda r: (r["score"], -r["bin"]))
                out.append((region, island, chrom, x[0]["start"], x[-1]["end"], len(x), peak["start"], float(peak["score"]), p))
            yield pd.DataFrame(out, columns=["region", "island", "chrom", "start", "end", "bins", "peak", "peak_score", "p"])

    return grouped.mapInPandas(run, f"region string, island long, {SCHEMA}")


def boundaries(scored: DataFrame, cutoff: float, states: int = 2, state: int = 0) -> DataFrame:
    """(chrom, start, end, bins, peak, peak_score, p): the intervals of score > cutoff around the ends of domains.

    Two states: the ends of the runs of `state`; a run counts if both its ends have an interval, and gives a row for either, even where
    they share it. Three states: a row for every change and for either end of a region, where there is an interval.
    p: the probability of a single change over the interval in the likeliest direction (three states: of those from or to the
    state that the interval begins with); peak: the first bin with the highest score.
    """
    w = Window.partitionBy("region").orderBy("bin")
    marked = _islands(scored, F.col("score") > cutoff)
    beside = F.coalesce("_island", F.lag("_island").over(w))
    # an end lies before a run's first bin; the last run ends after the region's last bin
    first = marked.withColumn("_beside", beside).withColumn("_before", F.lag("_run").over(w)).withColumn("_was", F.lag("state").over(w)).filter("_before IS NULL OR _before <> _run")
    last = marked.withColumn("_after", F.lead("_run").over(w)).filter("_after IS NULL").select("region", F.col("_run").alias("run"), F.col("state").alias("of"), F.lit(2).alias("which"), F.col("_island").alias("island"))
    opens = first.select("region", F.col("_run").alias("run"), F.col("state").alias("of"), F.lit(1).alias("which"), F.col("_beside").alias("island"))
    if states == 2:
        closes = first.filter("_before IS NOT NULL").select("region", F.col("_before").alias("run"), F.col("_was").alias("of"), F.lit(2).alias("which"), F.col("_beside").alias("island"))
        ends = opens.union(closes).union(last).filter((F.col("of") == state) & F.col("island").isNotNull())
        both = F.count("*").over(Window.partitionBy("region", "run")) == 2
        ends = ends.withColumn("_both", both).filter("_both")
    else:
        ends = opens.union(last).filter("island IS NOT NULL")
    return ends.select("region", "island").join(_summaries(marked, states), ["region", "island"]).drop("region", "island")


def boundary_islands(scored: DataFrame, cutoff: float, states: int = 2) -> DataFrame:
    """The intervals of score >= cutoff that hold a change of state, once each, with the columns of boundaries()."""
    w = Window.partitionBy("region").orderBy("bin")
    turned = scored.withColumn("_turn", F.coalesce(F.lag("state").over(w) != F.col("state"), F.lit(False)))
    marked = _islands(turned, F.col("score") >= cutoff)
    held = marked.filter("_turn AND _island IS NOT NULL").select("region", F.col("_island").alias("island")).distinct()
    return held.join(_summaries(marked, states), ["region", "island"]).drop("region", "island")
