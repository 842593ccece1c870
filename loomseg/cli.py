"""Command line: one (single sample), diff (two samples), zones (unmappable zones).

    python -m loomseg.cli one reads.bed --chrom sizes.bed --out domains --score scores
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import segment
from .sources import bam, sinks, text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomseg", description="Segments an axis by the density of point events.")
    sub = p.add_subparsers(dest="program", required=True)
    for name, inputs in (("one", ["reads"]), ("diff", ["reads_a", "reads_b"])):
        s = sub.add_parser(name)
        for i in inputs:
            s.add_argument(i)
        d = segment.Settings() if name == "one" else segment.DIFFERENCE
        s.add_argument("-o", "--out", required=True)
        s.add_argument("-c", "--chrom", required=True, help="sizes of the axes")
        for path in ("score", "readcount", "boundary", "boundary-score", "param-in", "param-out"):
            s.add_argument(f"--{path}")
        s.add_argument("-d", "--deadzones")
        s.add_argument("-B", "--bam", action="store_true", help="binary alignments instead of interval text")
        s.add_argument("-i", "--maxitr", type=int, default=d.max_iterations, dest="max_iterations")
        s.add_argument("-b", "--bin-size", type=int, default=0)
        s.add_argument("--bin-step", type=int, default=d.bin_step)
        s.add_argument("--duplicates", action="store_true", help="keep duplicates")
        s.add_argument("--fragment-length", "--fragment_length", type=int, default=0)
        for flag, chooser in (("Waterman", "waterman"), ("Hideaki", "hideaki"), ("Hideaki-emp", "empirical")):
            s.add_argument(f"--{flag}", action="store_const", const=chooser, dest="chooser", default="empirical")
        s.add_argument("--no-smooth", action="store_false", dest="smooth")
        s.add_argument("--max-dead", type=float, default=d.max_dead)
        s.add_argument("-s", "--domain-size", type=float, default=d.domain_size)
        s.add_argument("-S", "--desert", type=int, default=d.desert)
        s.add_argument("-F", "--fg", default=d.foreground, dest="foreground")
        s.add_argument("--bg", default=d.background, dest="background")
        s.add_argument("-P", "--posterior", action="store_true")
        s.add_argument("--posterior-cutoff", type=float, default=d.posterior_cutoff)
        s.add_argument("--undefined", type=int, default=d.undefined)
        s.add_argument("--cutoff", type=float, default=d.cutoff)
        s.add_argument("-v", "--verbose", action="store_true")
        s.add_argument("--config-file")
        if name == "diff":
            s.add_argument("-m", "--mode", type=int, default=2, choices=(2, 3))
            s.add_argument("--training-size", type=int, default=0)
    z = sub.add_parser("zones")
    z.add_argument("fasta")
    z.add_argument("-o", "--out", required=True)
    z.add_argument("-k", "--kmer", type=int, required=True)
    z.add_argument("-p", "--prefix", type=int, default=5)
    z.add_argument("-s", "--suffix", default="fa")
    z.add_argument("-v", "--verbose", action="store_true")
    z.add_argument("--config-file")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """Options; a settings file gives what the command line does not."""
    if "--config-file" in argv:
        path = argv[argv.index("--config-file") + 1]
        with open(path) as f:
            for k, v in text.read_settings(f.read()).items():
                if f"--{k}" not in argv:
                    argv = [*argv, f"--{k}"] + ([] if v.lower() in ("true", "on") else [v])
    return _parser().parse_args(argv)


def _reads(spark: SparkSession, path: str, binary: bool):
    if not binary:
        return text.read_bed(spark, path)
    bam.register(spark)
    return text.sam_intervals(spark.read.format("bam").option("path", path).load())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("loomseg").getOrCreate()
    if a.program == "zones":
        sinks.write_dead_zones(segment.dead_zones(text.read_fasta(spark, a.fasta, a.suffix), a.kmer, a.prefix), a.out)
        return 0
    base = segment.Settings() if a.program == "one" else segment.DIFFERENCE
    s = replace(base, **{k: v for k, v in vars(a).items() if k in base.__dataclass_fields__})
    chroms, dead = text.read_chrom_sizes(spark, a.chrom), text.read_dead(spark, a.deadzones)
    model = sinks.read_model(spark, a.param_in) if a.param_in else None
    if a.program == "one":
        out = segment.segment(_reads(spark, a.reads, a.bam), chroms, s, dead, model)
    else:
        out = segment.segment_pair(_reads(spark, a.reads_a, a.bam), _reads(spark, a.reads_b, a.bam), chroms, s, dead, model, a.mode)
    sinks.write_domains(out.domains, a.out)
    if a.score:
        n = out.model.n
        p = [F.col("p")[0]] if n == 2 else [F.col("p")[0], F.col("p")[2]]
        sinks.write_scores(out.bins.withColumns({f"p{i}": c for i, c in enumerate(p)}), a.score, [f"p{i}" for i in range(len(p))])
    if a.readcount:
        sinks.write_counts(out.bins, a.readcount, list(out.counts))
    if a.boundary:
        sinks.write_boundaries(out.boundaries(s.seed), a.boundary)
        if a.boundary_score:
            sinks.write_scores(out.boundary_scores(), a.boundary_score, ["score"])
    if a.param_out:
        sinks.write_model(spark, out.model, a.param_out)
    if a.verbose:
        print(sinks.report(out.model))
    out.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
