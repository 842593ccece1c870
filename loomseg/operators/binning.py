"""Reads to bins: consecutive dedup, fragment centres, tumbling bins, coverage by dead stretches, re-binning, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge

#: Bins that one generated row stands for before it is exploded: a long axis is spread over tasks.
SPAN = 65_536


def drop_consecutive(reads: DataFrame) -> DataFrame:
    """Drops a read with the chrom, start and strand of the one before it in (chrom, start, end, strand) order; its end does not count."""
    w = Window.partitionBy("chrom", "start").orderBy("end", "strand")
    # only reads of one start can repeat each other, so the window is no longer than those
    return reads.withColumn("_prev", F.lag("strand").over(w)).filter("_prev IS NULL OR _prev <> strand").drop("_prev")


def fragment_centre(start: Column, end: Column, strand: Column, fragment: int) -> Column:
    half = fragment // 2
    return F.when(strand == "+", start + half).otherwise(end - half - 1)


def is_sorted(reads: DataFrame) -> bool:
    """Whether a table with a column `pos` giving the file's order is sorted by chrom, start, end, strand."""
    w = Window.partitionBy("chrom").orderBy("pos")
    now = F.struct("start", "end", "strand")
    return reads.select(now.alias("now"), F.lag(now).over(w).alias("before")).filter("before > now").isEmpty()


def grid(chroms: DataFrame, step: int) -> DataFrame:
    """(chrom, bin, start, end): [0, step), [step, 2 step) ... below each axis' width; the last may reach beyond it."""
    n = F.ceil((F.col("end") - F.col("start")) / step).cast("long")
    parts = chroms.select("chrom", n.alias("n")).filter("n > 0").select("chrom", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPAN))).alias("part"))
    first = F.col("part") * SPAN
    bins = parts.select("chrom", F.explode(F.sequence(first, F.least(first + SPAN, F.col("n")) - 1)).alias("bin"))
    return bins.select("chrom", "bin", (F.col("bin") * step).alias("start"), ((F.col("bin") + 1) * step).alias("end"))


def bin_counts(reads: DataFrame, chroms: DataFrame, step: int, fragment: int = 0, duplicates: bool = False) -> DataFrame:
    """(chrom, bin, n): reads by the bin of their centre. Positions off the axis are dropped; no theta join is needed."""
    kept = reads if duplicates else drop_consecutive(reads)
    pos = fragment_centre(F.col("start"), F.col("end"), F.col("strand"), fragment)
    width = chroms.select("chrom", (F.ceil((F.col("end") - F.col("start")) / step) * step).alias("width"))
    counted = kept.select("chrom", pos.alias("pos")).filter("pos >= 0").groupBy("chrom", F.floor(F.col("pos") / step).alias("bin")).agg(F.count("*").alias("n"))
    return counted.join(width, "chrom").filter(F.col("bin") * step < F.col("width")).drop("width")


def dead_coverage(dead: DataFrame, step: int) -> DataFrame:
    """(chrom, bin, dead): positions of each bin that dead stretches cover; where stretches overlap, once."""
    cells = merge(dead.filter("end > start")).select("chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step))).alias("bin"))
    part = F.least("end", (F.col("bin") + 1) * step) - F.greatest("start", F.col("bin") * step)
    return cells.groupBy("chrom", "bin").agg(F.sum(part).alias("dead"))


def load_bins(samples: dict[str, DataFrame], chroms: DataFrame, step: int, dead: DataFrame | None = None, fragment: int = 0, duplicates: bool = False) -> DataFrame:
    """The whole grid with a count per sample (its key names the column) and scale, the observable share of each bin."""
    bins = grid(chroms, step)
    for name, reads in samples.items():
        bins = bins.join(bin_counts(reads, chroms, step, fragment, duplicates).withColumnRenamed("n", name), ["chrom", "bin"], "left")
    scale = F.lit(1.0)
    if dead is not None:
        bins = bins.join(dead_coverage(dead, step), ["chrom", "bin"], "left")
        scale = 1.0 - F.coalesce("dead", F.lit(0)) / step
    return bins.select("chrom", "bin", "start", "end", *[F.coalesce(name, F.lit(0)).cast("double").alias(name) for name in samples], scale.cast("double").alias("scale"))


def rebin(bins: DataFrame, step: int, size: int, counts: list[str]) -> DataFrame:
    """Groups of size / step bins: counts summed, scale averaged; a trailing group that is not full is dropped."""
    n = size // step
    out = bins.groupBy("chrom", F.floor(F.col("bin") / n).alias("bin")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in counts], F.avg("scale").alias("scale"), F.count("*").alias("_n")
    )
    return out.filter(F.col("_n") == n).drop("_n")


def desert_regions(bins: DataFrame, size: int, desert: int, max_dead: float = 0.5) -> DataFrame:
    """Keeps bins of scale > 1 - max_dead and numbers regions: a gap of more than `desert` positions begins the next one.

    A session window per axis; region is a string key, unique over axes.
    """
    w = Window.partitionBy("chrom").orderBy("bin")
    gap = (F.col("bin") - F.lag("bin").over(w) - 1) * size > desert
    kept = bins.filter(F.col("scale") > 1 - max_dead).withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    return kept.withColumn("region", F.concat_ws(":", "chrom", F.sum("_new").over(w).cast("string"))).drop("_new")


def cap_counts(bins: DataFrame, size: int, counts: list[str]) -> DataFrame:
    return bins.withColumns({c: F.least(c, F.lit(float(size))) for c in counts})


def training_prefix(bins: DataFrame, n: int) -> DataFrame:
    """The first n bins in axis order, whole table if n is 0. Positions come from bins per axis, so no global sort is needed."""
    if not n:
        return bins
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    per = bins.groupBy("chrom").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("chrom").orderBy("bin"))
    return bins.join(per.select("chrom", "_before"), "chrom").withColumn("_at", F.col("_before") + at).filter(F.col("_at") <= n).drop("_at", "_before")
