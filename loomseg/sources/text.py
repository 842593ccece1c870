"""Text sources: intervals, sizes, alignments, sequences, qualities, file lists, settings."""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import apply_cigar, cigar_ops, has_flag, quality_scale, reference_length, reverse_complement
from ..operators.alignments import REVERSE, SECONDARY, UNMAPPED
from .ranges import read_fasta, read_fasta_pieces, read_fastq, sequence_under  # noqa: F401  the sources of this module are one list


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank and not headers for a browser."""
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*$") & ~F.col("value").rlike("^(browser|track)"))


def read_bed(spark: SparkSession, path: str | list[str], columns: int = 6, strict: bool = True) -> DataFrame:
    """Intervals of 3, 6 or 8 columns between white space. Fields that are missing get defaults; fewer than 3 fields is an error if strict, else no row."""
    p = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(p.alias("p"))
    short = F.size("p") < 3
    rows = rows.withColumn("p", F.when(short, F.raise_error(F.concat(F.lit("bad interval: "), F.array_join("p", " ")))).otherwise(F.col("p"))) if strict else rows.filter(~short)
    at = lambda i: F.try_element_at("p", F.lit(i + 1))
    out = [at(0).alias("chrom"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end")]
    if columns >= 6:
        out += [F.coalesce(at(3), F.lit("X")).alias("name"), F.coalesce(at(4).cast("double"), F.lit(0.0)).alias("score"), F.coalesce(at(5), F.lit("+")).alias("strand")]
    if columns >= 8:
        out += [at(6).alias("seq"), at(7).alias("scr")]
    return rows.select(*out)


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_bed(spark, path, 3)


def read_dead(spark: SparkSession, path: str | None) -> DataFrame | None:
    return read_bed(spark, path, 3) if path else None


def parse_sam(lines: Column) -> list[Column]:
    p = F.split(lines, "\t")
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    whole = {"flag": "int", "pos": "int", "mapq": "int", "pnext": "int", "tlen": "int"}
    cols = {n: p[i].cast(whole[n]) if n in whole else p[i] for i, n in enumerate(names)}
    cols["pos"], cols["pnext"] = cols["pos"] - 1, cols["pnext"] - 1
    tags = F.map_from_entries(F.transform(F.filter(F.slice(p, F.lit(12), F.greatest(F.size(p) - 11, F.lit(0))), lambda x: x.rlike("^..:.:")), lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, "^..:.:", ""))))
    return [*[c.alias(n) for n, c in cols.items()], tags.alias("tags")]


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments with positions from 0 and a map of tags."""
    return spark.read.text(path).filter(~F.col("value").startswith("@")).select(*parse_sam(F.col("value")))


def sam_intervals(sam: DataFrame) -> DataFrame:
    """Mapped alignments as intervals: name, mapping quality as score, strand by the flag."""
    return sam.filter(~has_flag(F.col("flag"), UNMAPPED)).select(
        F.col("rname").alias("chrom"), F.col("pos").cast("long").alias("start"), (F.col("pos") + reference_length(F.col("cigar"))).cast("long").alias("end"),
        F.col("qname").alias("name"), F.col("mapq").cast("double").alias("score"), F.when(has_flag(F.col("flag"), REVERSE), "-").otherwise("+").alias("strand"),
    )


def sam_reads(sam: DataFrame, mapper: str = "general") -> DataFrame:
    """Reads laid along the axis with sequence and quality, by what each mapper writes.

    score: mismatches (NM; for bismark without converted bases; 0 for general). Reverse reads are complemented except for bsmap.
    """
    if mapper not in ("general", "bsmap", "bismark", "bs_seeker"):
        raise ValueError(f"unknown mapper: {mapper}")
    reverse = has_flag(F.col("flag"), REVERSE)
    kept = sam.filter(~has_flag(F.col("flag"), UNMAPPED))
    if mapper == "general":
        kept = kept.filter(~has_flag(F.col("flag"), SECONDARY))
    nm = F.coalesce(F.col("tags")["NM"].cast("double"), F.lit(0.0))
    converted = F.length(F.regexp_replace(F.coalesce(F.col("tags")["XM"], F.lit("")), "[^xhz]", ""))
    score = {"general": F.lit(0.0), "bismark": nm - converted}.get(mapper, nm)
    seq = apply_cigar(F.col("cigar"), F.col("seq"), "N")
    qual = F.repeat(F.lit("h"), F.length("seq").cast("int")) if mapper == "bs_seeker" else F.col("qual")
    scr = apply_cigar(F.col("cigar"), qual, "B")
    turn = reverse & F.lit(mapper != "bsmap")
    return kept.select(
        F.col("rname").alias("chrom"), F.col("pos").cast("long").alias("start"), (F.col("pos") + F.length(seq)).cast("long").alias("end"), F.col("qname").alias("name"), score.alias("score"),
        F.when(reverse, "-").otherwise("+").alias("strand"), F.when(turn, reverse_complement(seq)).otherwise(seq).alias("seq"), F.when(turn, F.reverse(scr)).otherwise(scr).alias("scr"),
    )


def extract_sequences(regions: DataFrame, seqs: DataFrame) -> DataFrame:
    """Adds seq, the bases under each region, complemented on the - strand."""
    piece = F.substring("_s", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    met = regions.join(seqs.select(F.col("name").alias("_n"), F.col("seq").alias("_s")), F.col("chrom") == F.col("_n"))
    strand = F.col("strand") if "strand" in regions.columns else F.lit("+")
    return met.withColumn("seq", F.when(strand == "-", reverse_complement(piece)).otherwise(piece)).drop("_n", "_s")


def detect_scale(reads: DataFrame) -> DataFrame:
    """(scale): what quality characters a table's qual holds says of their scale, by the smallest and the largest one; null if none fits or there is none."""
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c))
    return reads.filter("qual <> ''").agg(F.min(F.array_min(codes)).alias("lo"), F.max(F.array_max(codes)).alias("hi")).select(quality_scale(F.col("lo"), F.col("hi")).alias("scale"))


def read_quality_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(values array<array<double>>): four numbers a base on each line."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = spark.read.text(path).filter("trim(value) <> ''").select(numbers.alias("v"))
    bad = F.size("v") % 4 != 0
    fours = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 4).cast("int") - 1), lambda i: F.slice("v", i * 4 + 1, 4))
    return rows.select(F.when(bad, F.raise_error(F.lit("the numbers of a line are not a multiple of 4"))).otherwise(fours).alias("values"))


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """One file name a line; the list is the driver's plan of what to read."""
    return [r.value.strip() for r in spark.read.text(path).filter("trim(value) <> ''").collect()]


def read_settings(text: str) -> dict[str, str]:
    """`key = value` lines with # comments."""
    p = configparser.ConfigParser(inline_comment_prefixes=("#",), comment_prefixes=("#",), delimiters=("=",), interpolation=None)
    p.read_string("[all]\n" + text)
    return dict(p["all"])


def cigar_table(sam: DataFrame) -> DataFrame:
    return sam.select("qname", F.inline(cigar_ops(F.col("cigar"))))
