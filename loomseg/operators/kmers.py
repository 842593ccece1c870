"""Duplicate k-mers: start positions whose k-mer occurs again on either strand are unmappable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bisulfite, reverse_complement
from .intervals import merge

#: Start positions that one generated row stands for.
SPAN = 4096


def kmers(seqs: DataFrame, k: int, prefix: int = 5, convert: str | None = None) -> DataFrame:
    """(name, pos, kmer): every window of both strands at its forward start; the first `prefix` letters must be bases. convert: C or G, for converted reads."""
    s = F.upper("seq")
    n = F.length("seq") - k + 1
    # a window is taken from a short part, and a part from a block, so that no cut runs through a long sequence from its start
    def cut(rows: DataFrame, span: int) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), F.floor((F.length("s") - k) / span).cast("int"))).alias("p")
        return rows.select("name", "at", "s", at).select("name", (F.col("at") + F.col("p") * span).alias("at"), F.expr(f"substring(s, p * {span} + 1, {span} + {k} - 1)").alias("s"))

    part = cut(cut(seqs.filter(n > 0).select("name", F.lit(0).cast("long").alias("at"), s.alias("s")), SPAN * 256), SPAN).withColumnRenamed("s", "piece")
    starts = part.select("name", "at", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - k)).alias("i"))
    window = F.substring("piece", F.col("i") + 1, F.lit(k))
    change = (lambda c: c) if convert is None else (lambda c: bisulfite(c, "+" if convert == "C" else "-"))
    both = starts.select("name", (F.col("at") + F.col("i")).cast("long").alias("pos"), F.explode(F.array(F.struct(change(window).alias("kmer"), F.lit("+").alias("strand")), F.struct(change(reverse_complement(window)).alias("kmer"), F.lit("-").alias("strand")))).alias("x"))
    valid = both.select("name", "pos", "x.*").filter(F.substring("kmer", 1, prefix).rlike(f"^[ACGT]{{{prefix}}}$"))
    return valid


def duplicate_positions(seqs: DataFrame, k: int, prefix: int = 5, convert: str | None = None) -> DataFrame:
    """(name, pos[, strand]): starts of k-mers that occur more than once. Long k-mers travel as 128 bits of hash, are counted, and joined back."""
    keyed = kmers(seqs, k, prefix, convert).select("name", "pos", "strand", *([F.col("kmer").alias("h1"), F.lit(0).alias("h2")] if k <= 40 else [F.xxhash64("kmer").alias("h1"), F.xxhash64("kmer", F.lit(1)).alias("h2")]))
    # a palindrome meets itself on the other strand: that is no second place
    places = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    out = keyed.join(places, ["h1", "h2"], "left_semi")
    return out.select("name", "pos", "strand").distinct() if convert else out.select("name", "pos").distinct()


def gap_runs(seqs: DataFrame, least: int = 50) -> DataFrame:
    """(chrom, start, end): maximal runs of at least `least` N. Positions are sums of the lengths of what stands between."""
    s = F.upper("seq")
    pattern = f"N{{{least},}}"
    gaps, hits = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    rows = seqs.select("name", F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"))).alias("i", "x"))
    w = Window.partitionBy("name").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("name", F.length("x.h").alias("n"), F.sum(F.length("x.g") + F.length("x.h")).over(w).alias("e"))
    return ends.select(F.col("name").alias("chrom"), (F.col("e") - F.col("n")).alias("start"), F.col("e").alias("end"))


def position_runs(positions: DataFrame) -> DataFrame:
    """(chrom, start, end): successive positions as one stretch [first, last + 1)."""
    w = Window.partitionBy("name").orderBy("pos")
    return positions.select("name", "pos").distinct().withColumn("i", F.col("pos") - F.row_number().over(w)).groupBy(F.col("name").alias("chrom"), "i").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("i")


def dead_zones(seqs: DataFrame, k: int, prefix: int = 5, least_gap: int = 50) -> DataFrame:
    """(chrom, start, end): unmappable starts and long gaps, touching ones merged."""
    return merge(position_runs(duplicate_positions(seqs, k, prefix)).unionByName(gap_runs(seqs, least_gap)))
