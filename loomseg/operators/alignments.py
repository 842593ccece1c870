"""Operators on alignments (qname, flag, rname, pos from 0, mapq, cigar, rnext, pnext, tlen, seq, qual)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cigar_ops, has_flag, reference_length
from .intervals import semi

# The flag's bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE = (1 << i for i in range(11))


def view(sam: DataFrame, mapq: int = 0, on: int = 0, off: int = 0, regions: DataFrame | None = None) -> DataFrame:
    """Alignments of a least quality, with all bits of `on` and none of `off`, that overlap the regions if given."""
    kept = sam.filter((F.col("mapq") >= mapq) & (F.col("flag").bitwiseAND(F.lit(on)) == on) & (F.col("flag").bitwiseAND(F.lit(off)) == 0))
    if regions is None:
        return kept
    spans = kept.withColumns({"chrom": F.col("rname"), "start": F.col("pos").cast("long"), "end": (F.col("pos") + reference_length(F.col("cigar"))).cast("long")})
    return semi(spans, regions).drop("chrom", "start", "end")


def flagstat(sam: DataFrame) -> DataFrame:
    """(what, passed, failed): conditional counts over flags, by the quality check's bit; one aggregation."""
    f = lambda bit: has_flag(F.col("flag"), bit)
    mapped, paired = ~f(UNMAPPED), f(PAIRED)
    both = paired & mapped & ~f(MATE_UNMAPPED)
    other = both & (F.col("rnext") != "=") & (F.col("rnext") != F.col("rname"))
    tests = {
        "total": F.lit(True), "duplicates": f(DUPLICATE), "mapped": mapped, "paired": paired, "read1": paired & f(FIRST), "read2": paired & f(SECOND),
        "properly paired": paired & f(PROPER) & mapped, "both mapped": both, "singletons": paired & mapped & f(MATE_UNMAPPED), "mate elsewhere": other, "mate elsewhere, mapq 5": other & (F.col("mapq") >= 5),
    }
    sums = sam.agg(*[F.count_if(t & ~f(FAILED)).alias(f"p{i}") for i, t in enumerate(tests.values())], *[F.count_if(t & f(FAILED)).alias(f"f{i}") for i, t in enumerate(tests.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"p{i}").alias("passed"), F.col(f"f{i}").alias("failed")) for i, n in enumerate(tests)])
    return sums.select(F.inline(rows))


def idxstats(sam: DataFrame) -> DataFrame:
    return sam.groupBy("rname").agg(F.count_if(~has_flag(F.col("flag"), UNMAPPED)).alias("mapped"), F.count_if(has_flag(F.col("flag"), UNMAPPED)).alias("unmapped"))


def sort(sam: DataFrame, by_name: bool = False) -> DataFrame:
    return sam.orderBy("qname", "flag") if by_name else sam.orderBy("rname", "pos")


def merge_sorted(parts: list[DataFrame], by_name: bool = False) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return sort(out, by_name)


def remove_duplicates(sam: DataFrame, paired: bool = False) -> DataFrame:
    """Of alignments at one place the best stays: by summed base quality, then name. Unmapped ones all stay.

    Single: place is the strand and the 5' end. Paired: the first position and the insert's length, judged on the leftmost mate.
    """
    reverse = has_flag(F.col("flag"), REVERSE)
    end = F.col("pos") + reference_length(F.col("cigar"))
    key = [F.col("rname"), F.col("pos"), F.col("tlen")] if paired else [F.col("rname"), reverse, F.when(reverse, end).otherwise(F.col("pos"))]
    quality = F.aggregate(F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33), F.lit(0), lambda a, q: a + q)
    mapped = sam.filter(~has_flag(F.col("flag"), UNMAPPED))
    judged = mapped.filter("tlen > 0") if paired else mapped
    w = Window.partitionBy(*key).orderBy(F.col("_q").desc(), "qname")
    best = judged.withColumn("_q", quality).withColumn("_r", F.row_number().over(w))
    if paired:
        worse = best.filter("_r > 1").select("qname").distinct()
        return sam.join(worse, "qname", "left_anti").select(*sam.columns)
    return best.filter("_r = 1").drop("_q", "_r").unionByName(sam.filter(has_flag(F.col("flag"), UNMAPPED)))


#: Positions of a cell: windows run inside cells, which stretches are cut at.
CELL = 1 << 16


def covered(cigar: Column, pos: Column) -> Column:
    """array<struct<s, n, y>>: the stretches that an alignment covers, and where each begins in its read (from 0); deletions and skips part them."""

    def step(acc, o):
        lies, moves, reads = o["op"].isin("M", "=", "X"), o["op"].isin("M", "=", "X", "D", "N"), o["op"].isin("M", "=", "X", "I", "S")
        one = F.struct(acc["at"].alias("s"), o["n"].alias("n"), acc["y"].alias("y"))
        return F.struct((acc["at"] + F.when(moves, o["n"]).otherwise(0)).alias("at"), (acc["y"] + F.when(reads, o["n"]).otherwise(0)).alias("y"), F.when(lies, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(pos.cast("long").alias("at"), F.lit(0).alias("y"), F.array().cast("array<struct<s:bigint,n:int,y:int>>").alias("out"))
    return F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"])


def depth(sam: DataFrame, mapq: int = 0, least_quality: int = 0, samples: list[str] | None = None, sample: str = "sample", regions: DataFrame | None = None) -> DataFrame:
    """(rname, pos, depth): how many alignments cover each position, from changes at the ends of covered stretches; no position is made per read.

    samples: values of a column that tells samples apart, each of which has a column of its own in place of depth; positions that any covers have a row, others' values don't count. least_quality:
    bases below it don't cover their position. regions (chrom, start, end): only positions in one. Stretches are cut at cells' borders, and each cell is summed by itself.
    """
    kept = sam.filter((F.col("mapq") >= mapq) & ~has_flag(F.col("flag"), UNMAPPED | SECONDARY | FAILED | DUPLICATE))
    who = [F.col(sample).cast("string").alias("who")] if samples is not None else []
    laid = kept.select("rname", *who, "qual", F.explode(covered(F.col("cigar"), F.col("pos"))).alias("x")).select("rname", *[c for c in ("who",) if who], "qual", "x.*")
    if least_quality > 0:
        codes = F.transform(F.split(F.substring("qual", F.col("y") + 1, F.col("n")), ""), lambda c: F.ascii(c) - 33)
        laid = laid.select("*", F.posexplode(codes).alias("k", "c")).filter(F.col("c") >= least_quality).withColumns({"s": F.col("s") + F.col("k"), "n": F.lit(1)})
    cells = laid.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / CELL), F.floor((F.col("s") + F.col("n") - 1) / CELL))))
    first, last = F.greatest("s", F.col("cell") * CELL), F.least(F.col("s") + F.col("n"), (F.col("cell") + 1) * CELL)
    ends = F.explode(F.array(F.struct(first.alias("p"), F.lit(1).alias("d")), F.struct(last.alias("p"), F.lit(-1).alias("d")))).alias("x")
    edges = cells.select("rname", "cell", *[c for c in ("who",) if who], ends)
    names = ["depth"] if samples is None else list(samples)
    sums = [F.sum("x.d" if samples is None else F.when(F.col("who") == n, F.col("x.d")).otherwise(0)).alias(f"d{i}") for i, n in enumerate(names)]
    w = Window.partitionBy("rname", "cell").orderBy("p")
    swept = edges.groupBy("rname", "cell", F.col("x.p").alias("p")).agg(*sums).withColumns({f"n{i}": F.sum(f"d{i}").over(w) for i in range(len(names))} | {"q": F.lead("p").over(w)})
    deep = swept.filter(" OR ".join(f"n{i} > 0" for i in range(len(names))))
    out = deep.select("rname", F.explode(F.sequence("p", F.col("q") - 1)).alias("pos"), *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])
    if regions is None:
        return out
    return semi(out.withColumns({"chrom": F.col("rname"), "start": F.col("pos"), "end": F.col("pos") + 1}), regions).drop("chrom", "start", "end")


def pileup(sam: DataFrame) -> DataFrame:
    """(rname, pos, depth, bases): the bases that alignments lay on each position, sorted."""
    from ..functions.columns import apply_cigar

    laid = sam.filter(~has_flag(F.col("flag"), UNMAPPED)).select("rname", F.col("pos").alias("at"), F.posexplode(F.split(apply_cigar(F.col("cigar"), F.col("seq"), "*"), "")).alias("i", "base"))
    return laid.filter("base <> '*'").groupBy("rname", (F.col("at") + F.col("i")).alias("pos")).agg(F.count("*").alias("depth"), F.array_join(F.array_sort(F.collect_list("base")), "").alias("bases"))


def fix_mates(sam: DataFrame) -> DataFrame:
    """Mate columns from the other primary alignment of the same name: rnext, pnext, tlen and the mate's bits of the flag."""
    m = sam.filter(~has_flag(F.col("flag"), SECONDARY)).select(F.col("qname").alias("q"), has_flag(F.col("flag"), FIRST).alias("one"), F.col("rname").alias("mr"), F.col("pos").alias("mp"), F.col("flag").alias("mf"), (F.col("pos") + reference_length(F.col("cigar"))).alias("me"))
    own = has_flag(F.col("flag"), FIRST)
    met = sam.join(m, (F.col("qname") == F.col("q")) & (own != F.col("one")), "left")
    end = F.col("pos") + reference_length(F.col("cigar"))
    span = F.greatest(end, "me") - F.least("pos", "mp")
    length = F.when(F.col("mr") != F.col("rname"), 0).when((F.col("pos") < F.col("mp")) | ((F.col("pos") == F.col("mp")) & own), span).otherwise(-span)
    bits = F.when(has_flag(F.col("mf"), REVERSE), MATE_REVERSE).otherwise(0) + F.when(has_flag(F.col("mf"), UNMAPPED), MATE_UNMAPPED).otherwise(0)
    flag = F.col("flag").bitwiseAND(F.lit(~(MATE_REVERSE | MATE_UNMAPPED))) + bits
    there = F.col("q").isNotNull()
    new = {"rnext": F.when(there, F.when(F.col("mr") == F.col("rname"), "=").otherwise(F.col("mr"))).otherwise(F.col("rnext")), "pnext": F.when(there, F.col("mp")).otherwise(F.col("pnext")), "tlen": F.when(there, length).otherwise(F.col("tlen")), "flag": F.when(there, flag).otherwise(F.col("flag"))}
    return met.withColumns(new).select(*sam.columns)
