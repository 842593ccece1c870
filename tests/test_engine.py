"""Recursions by brute force, planted domains, sources and sinks by round trips."""

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseg.functions import columns as fx
from loomseg.functions.distributions import Weighted, log_bessel_i, make
from loomseg.operators import binning, boundaries, domains, hmm, intervals, kmers
from loomseg.plans import segment
from loomseg.sources import bam, sinks, text


def _model(n, seed):
    r = np.random.default_rng(seed)
    t = r.random((n, n)) + 0.1
    return hmm.Model([make("pois 1")] * n, np.full(n, 1 / n), t / t.sum(axis=1, keepdims=True) * 0.9, r.random(n) * 0.1 + 0.01)


@pytest.mark.parametrize("n,length,seed", [(2, 1, 1), (2, 7, 2), (3, 6, 3), (2, 9, 4)])
def test_recursions_by_enumeration(n, length, seed):
    m, ll = _model(n, seed), np.random.default_rng(seed).normal(size=(length, n))
    paths = list(itertools.product(range(n), repeat=length))

    def weight(p):
        x = math.log(m.start[p[0]]) + sum(ll[t, s] for t, s in enumerate(p)) + math.log(m.end[p[-1]])
        return x + sum(math.log(m.trans[a, b]) for a, b in itertools.pairwise(p))

    w = np.exp([weight(p) for p in paths])
    gamma, total = hmm.posteriors(m, ll)
    assert total == pytest.approx(math.log(w.sum()))
    want = np.array([[sum(x for x, p in zip(w, paths, strict=True) if p[t] == s) for s in range(n)] for t in range(length)]) / w.sum()
    assert gamma == pytest.approx(want)
    xi = hmm.transition_posteriors(m, ll)
    for t in range(1, length):
        assert xi[t] == pytest.approx(np.array([[sum(x for x, p in zip(w, paths, strict=True) if p[t - 1] == a and p[t] == b) for b in range(n)] for a in range(n)]) / w.sum())
    assert tuple(hmm.viterbi(m, ll)) == paths[int(w.argmax())]


def test_long_region_equals_plain_recursion():
    m, ll = _model(2, 8), np.random.default_rng(8).normal(size=(5000, 2)) * 3
    v, total = m.start * np.exp(ll[0]), 0.0
    score, back = np.log(m.start) + ll[0], []
    for t in range(1, len(ll)):
        total += math.log(v.sum())
        v = v / v.sum() @ m.trans * np.exp(ll[t])
        moves = score[:, None] + np.log(m.trans)
        back.append(1 - np.flip(moves, 0).argmax(axis=0))
        score = moves.max(axis=0) + ll[t]
    assert hmm.posteriors(m, ll)[1] == pytest.approx(total + math.log(v @ m.end))
    s = [1 if score[1] + math.log(m.end[1]) >= score[0] + math.log(m.end[0]) else 0]
    for b in reversed(back):
        s.append(int(b[s[-1]]))
    assert hmm.viterbi(m, ll).tolist() == s[::-1]


def test_fits_recover_parameters():
    r = np.random.default_rng(4)
    k = r.negative_binomial(2.5, 2.5 / (2.5 + 6.0), 40_000).astype(float)
    u, w = np.unique(k, return_counts=True)
    mu, alpha = make("nbd 1 1").fitted(Weighted(u, np.ones(len(u)), w.astype(float))).params
    assert mu == pytest.approx(6, rel=0.05) and alpha == pytest.approx(0.4, rel=0.08)
    a, b = r.poisson(5, 5000).astype(float), r.poisson(2, 5000).astype(float)
    x = Weighted(a - b, np.ones(5000), np.ones(5000), a, b)
    assert make("skel 1 1").fitted(x).params == pytest.approx([a.mean(), b.mean()])
    assert make("gauss 1 1").fitted(x).params[0] == pytest.approx((a - b).mean())
    assert make("exp 1").fitted(x).params[0] == pytest.approx((a - b).mean())


def test_likelihoods_sum_to_one():
    k, s = np.arange(0, 400.0), np.ones(400)
    for d in ("pois 7", "nbd 7 0.5"):
        assert np.exp(make(d).log_likelihood(k, s)).sum() == pytest.approx(1, abs=1e-6)
    k = np.arange(-110, 111.0)
    for d in ("skel 7 4", "nbdiff 5 0.3 3 0.2"):
        assert np.exp(make(d).log_likelihood(k, np.ones(len(k)))).sum() == pytest.approx(1, abs=1e-4)
    assert np.exp(log_bessel_i(np.array([0.0]), np.array([1.0]))) == pytest.approx([1.2660658777520084])
    with pytest.raises(ValueError):
        make("cauchy 1")


def _planted(spark, seed=3, rate=(1.2, 9.0), n=2000):
    r = random.Random(seed)
    inside = [(400, 600), (1100, 1250), (1700, 1800)]
    rows = []
    for b in range(n):
        lam = rate[1] if any(x <= b < y for x, y in inside) else rate[0]
        for _ in range(np.random.default_rng(seed * 100_000 + b).poisson(lam)):
            s = b * 100 + r.randrange(100)
            rows.append(("c", s, s + 1, "x", 0.0, "+"))
    return spark.createDataFrame(rows, "chrom string, start long, end long, name string, score double, strand string"), inside, spark.createDataFrame([("c", 0, n * 100)], "chrom string, start long, end long")


def _overlap(found, inside):
    a = {b for x, y in inside for b in range(x, y)}
    g = {b for r in found for b in range(r.start // 100, r.end // 100)}
    return len(a & g) / len(a | g)


def test_planted_domains_single(spark):
    reads, inside, chroms = _planted(spark)
    s = segment.Settings(bin_step=100, bin_size=100, domain_size=10_000, duplicates=True)
    out = segment.segment(reads, chroms, s)
    assert _overlap(out.domains.collect(), inside) > 0.9
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(out.history))
    assert out.model.emissions[0].mean == pytest.approx(9, rel=0.15)
    edges = [100 * v for p in inside for v in p]
    near = lambda r: [e for e in edges if r.start - 500 <= e <= r.end + 500]
    loose = boundaries.boundaries(out.boundary_scores(), 0.2).collect()
    assert {e for r in loose for e in near(r)} == set(edges) and all(0 <= r.p <= 1 + 1e-9 for r in loose)
    strict = out.boundaries().collect()  # above what shuffled bins reach: fewer, none elsewhere
    assert strict and all(near(r) for r in strict)
    again = segment.segment(reads, chroms, s, model=sinks.model_from_text(sinks.model_text(out.model)))
    assert sorted(map(tuple, again.domains.collect())) == sorted(map(tuple, out.domains.collect()))


@pytest.mark.parametrize("mode,kind", [(2, "skel"), (3, "skel"), (2, "nbdiff")])
def test_planted_differences(spark, mode, kind):
    a, inside, chroms = _planted(spark, 5)
    b, _, _ = _planted(spark, 6, (1.2, 1.2))
    s = segment.Settings(bin_step=100, bin_size=100, domain_size=10_000, duplicates=True, posterior_cutoff=0.5, foreground=kind, background=kind, max_iterations=6)
    out = segment.segment_pair(a, b, chroms, s, mode=mode).domains.collect()
    up = [r for r in out if r.state in ("ENRICHED", "SAMPLE-I-ENRICHED")]
    assert _overlap(up, inside) > 0.8


def test_micro_cases(spark):
    reads = spark.createDataFrame([("c", 100, 136, "+"), ("c", 100, 136, "+"), ("c", 100, 136, "-"), ("c", 100, 140, "+")], "chrom string, start long, end long, strand string")
    assert sorted(map(tuple, binning.drop_consecutive(reads).collect())) == [("c", 100, 136, "+"), ("c", 100, 136, "-"), ("c", 100, 140, "+")]
    c = spark.range(1).select(binning.fragment_centre(F.lit(1000), F.lit(1036), F.lit("-"), 200), binning.fragment_centre(F.lit(1000), F.lit(1036), F.lit("+"), 0)).first()
    assert tuple(c) == (935, 1000)
    chroms = spark.createDataFrame([("c", 0, 120)], "chrom string, start long, end long")
    dead = spark.createDataFrame([("c", 40, 60)], "chrom string, start long, end long")
    bins = binning.load_bins({"reads": reads.limit(0)}, chroms, 50, dead).orderBy("bin").collect()
    assert [(b.start, b.end, round(b.scale, 6)) for b in bins] == [(0, 50, 0.8), (50, 100, 0.8), (100, 150, 1.0)]
    kept = spark.createDataFrame([("c", b, b * 100, b * 100 + 100, 1.0, 1.0) for b in (0, 1, 4, 8)], "chrom string, bin long, start long, end long, reads double, scale double")
    regions = {r.bin: r.region for r in binning.desert_regions(kept, 100, 200).collect()}
    assert regions[0] == regions[1] == regions[4] != regions[8]
    run = spark.createDataFrame([("c", "c", i, i * 10, i * 10 + 10, s, p) for i, (s, p) in enumerate(zip([0, 0, 0, 1, 1], [0.6, 0.96, 0.7, 0.8, 0.9], strict=True))], "region string, chrom string, bin long, start long, end long, state int, score double")
    lab = domains.label(run, "score", 0.95, 5).orderBy("bin").collect()
    assert [x.label for x in lab] == [0, 0, 0, -1, -1]
    lab = domains.label(run, "score", 0.95, 3000).orderBy("bin").collect()
    assert [x.label for x in lab] == [0, 0, 0, 1, 1]
    same = spark.createDataFrame([("s", "AACCTTGG" + "N" * 60 + "AACCTTGA")], "name string, seq string")
    zones = sorted(map(tuple, kmers.dead_zones(same, 6, 2).collect()))
    assert ("s", 8, 68) in [z for z in zones] or any(z[1] <= 8 and z[2] >= 68 for z in zones)


def test_single_change_by_enumeration():
    moves = np.random.default_rng(2).random((5, 2, 2))
    rows = moves / moves.sum(axis=2, keepdims=True)
    rows[0] = moves[0]  # the interval is entered by a joint posterior
    want = sum(np.prod([rows[t, 0, 0] for t in range(k)]) * rows[k, 0, 1] * np.prod([rows[t, 1, 1] for t in range(k + 1, 5)]) for k in range(5))
    assert boundaries.single_change(moves, 0, 1) == pytest.approx(want)


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.bed").write_text("track name=x\nc1\t5\t9\ta\t2.5\t-\nc2 1 4\n\n")
    assert sorted(map(tuple, text.read_bed(spark, str(tmp_path / "r.bed")).collect())) == [("c1", 5, 9, "a", 2.5, "-"), ("c2", 1, 4, "X", 0.0, "+")]
    (tmp_path / "s.fa").write_text(">one x\nACG\nTN\n>empty\n>two\nGG\n")
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "s.fa")).collect())) == [("one", "ACGTN"), ("two", "GG")]
    (tmp_path / "q.fq").write_text("@a b\nACG\n+\n@@@\n@c\nTT\n+c\nII\n")
    assert sorted(map(tuple, text.read_fastq(spark, str(tmp_path / "q.fq")).collect())) == [("a", "ACG", "@@@"), ("c", "TT", "II")]
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nq1\t16\tc1\t11\t30\t2M1I2M1D1M\t*\t0\t0\tACGTAC\tABCDEF\tNM:i:2\tXM:Z:xh.\n")
    sam = text.read_sam(spark, str(tmp_path / "x.sam"))
    assert tuple(text.sam_intervals(sam).first()) == ("c1", 10, 16, "q1", 30.0, "-")
    r = text.sam_reads(sam, "bismark").first()
    assert (r.start, r.end, r.score, r.seq) == (10, 16, 0.0, "GNTAGT")
    assert text.sam_reads(sam, "bsmap").first().seq == "ACTANC"
    assert text.read_settings("a = 1 # x\n# y\nb = two\n") == {"a": "1", "b": "two"}
    (tmp_path / "p.prb").write_text("1 2 3 4\t5 6 7 8\n")
    assert text.read_quality_matrix(spark, str(tmp_path / "p.prb")).first()[0] == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_binary_alignments(spark, tmp_path):
    def rec(name, flag, pos, mapq, cigar, seq):
        ops = b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in cigar)
        codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + bytes([30] * len(seq))
        return struct.pack("<i", len(body)) + body

    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    raw += rec("a", 0, 5, 20, [(3, "M"), (1, "D"), (2, "M")], "ACGTA") + rec("b", 16, 9, 60, [(4, "M")], "NNNA")
    out = b""
    for i in range(0, len(raw), 40):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += c.compress(raw[i : i + 40]) + c.flush()
    (tmp_path / "x.bam").write_bytes(out)
    bam.register(spark)
    df = spark.read.format("bam").option("path", str(tmp_path / "x.bam")).load()
    assert [(r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq) for r in df.collect()] == [("a", 0, "c1", 5, "3M1D2M", "ACGTA"), ("b", 16, "c1", 9, "4M", "NNNA")]
    assert [r.qname for r in df.filter("mapq >= 30").collect()] == ["b"]
    assert [r.end for r in text.sam_intervals(df).collect()] == [11, 13]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", 20, 30, "ENRICHED", 1.23456789, 2.0), ("c", 0, 10, "ENRICHED", 3.0, 1.0)], "chrom string, start long, end long, state string, mean double, score double")
    sinks.write_domains(rows, str(tmp_path / "d"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect())[1] == "c\t20\t30\tENRICHED\t1.23457\t2\t+"
    m = segment.fixed_model(["nbd 3 0.5", "nbd 1 0.1"], [0.9, 0.8])
    sinks.write_model(spark, m, str(tmp_path / "m"))
    got = sinks.read_model(spark, str(tmp_path / "m"))
    assert [str(d) for d in got.emissions] == [str(d) for d in m.emissions] and got.trans.tolist() == m.trans.tolist()


def test_small_functions(spark):
    r = spark.range(1).select(
        fx.log_sum(F.lit(-1.0), F.lit(-2.0)), fx.base_code(F.lit("g")), fx.kmer_index(F.lit("ACGT")), fx.split_quoted(F.lit("a 'b c' \"d\" e")), fx.percent(F.lit(2), F.lit(3)), fx.strip_suffix(F.lit("/x/y.bed")),
        fx.bisulfite(F.lit("ACGT")), fx.split_text(F.lit("a,,b"), ","), fx.error_to_phred(F.lit(0.01)), fx.quality_scores(F.lit("!I")),
    ).first()
    assert tuple(r) == (pytest.approx(math.log(math.exp(-1) + math.exp(-2))), 2, 27, ["a", "b c", "d", "e"], 66, "y", "ATGT", ["a", "b"], 20.0, [0, 40])


def test_transition_rules():
    moves = np.array([[9.0, 1.0], [2.0, 8.0]])
    m = hmm.Model([make("pois 3"), make("pois 1")], np.full(2, 0.5), np.full((2, 2), 0.5), np.array([0.02, 0.04]))
    assert hmm.transitions(m, moves, False) == pytest.approx(np.array([[0.89, 0.09], [0.18, 0.78]]))
    assert hmm.transitions(m, moves, True) == pytest.approx(np.array([[0.9, 0.08], [0.2, 0.76]]))
    m3 = hmm.Model([make("pois 3")] * 3, np.full(3, 1 / 3), np.eye(3), np.full(3, 0.1))
    assert hmm.transitions(m3, np.ones((3, 3)), True) == pytest.approx(np.full((3, 3), 1 / 3))


def test_overlapping_dead_stretches_count_once(spark):
    dead = spark.createDataFrame([("c", 0, 50), ("c", 0, 50), ("c", 10, 60)], "chrom string, start long, end long")
    chroms = spark.createDataFrame([("c", 0, 100)], "chrom string, start long, end long")
    reads = spark.createDataFrame([("c", 5, 41, "+")], "chrom string, start long, end long, strand string")
    got = {r.bin: r.scale for r in binning.load_bins({"reads": reads}, chroms, 50, dead).collect()}
    assert got == {0: pytest.approx(0.0), 1: pytest.approx(0.8)}


def test_ranges_of_an_ordered_column(spark, monkeypatch):
    from loomseg.operators import stats

    monkeypatch.setattr(stats, "LEAST_ROWS", 20)
    monkeypatch.setattr(stats, "RANGES", 8)
    rng = np.random.default_rng(1)
    x = rng.permutation(300) / 7
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert stats.percentile_cutoff(df, "x", 0.05) == np.sort(x)[285]
    got = {r.x: r.s for r in stats.running(df, "x", "x", "s").collect()}
    want = dict(zip(np.sort(x), np.cumsum(np.sort(x)), strict=True))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert stats.percentile_cutoff(spark.createDataFrame([(1.0,)] * 50, "x double"), "x") == 1.0


def test_equal_spans_meet_once(spark, monkeypatch):
    """Rows of joins made of lists and counts of equal spans, with nulls, long lists and no other column; before the last projection there are no more rows than pairs of spans."""
    monkeypatch.setattr(intervals, "LISTED", 4)
    monkeypatch.setattr(intervals, "COPIES", 3)
    schema = "id long, chrom string, start long, end long, tag string"
    rows = [(i % 7 or None, "xy"[i % 2] if i % 11 else None, (i * 3) % 13, (i * 3) % 13 + i % 5, "t" if i % 3 else None) for i in range(90)]
    a, b = rows[:50], rows[30:]
    same = lambda got, want: sorted(map(str, got)) == sorted(map(str, want))
    hit = [(x, y) for x in a for y in b if x[1] and x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and y[2] < x[3]]
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert same([(tuple(r.a), tuple(r.b)) for r in intervals.overlap_join(x, y, 4).collect()], hit)
    assert same([(r.a[0], r.b[0]) for r in intervals.overlap_join(x.drop("tag"), y.drop("tag"), 4).collect()], [(p[0], q[0]) for p, q in hit])
    assert same([(tuple(r.a), tuple(r.b)) for r in intervals.overlap_join(x.drop("tag", "id"), y.drop("tag", "id"), 4).collect()], [(p[1:4], q[1:4]) for p, q in hit])
    assert same([tuple(r) for r in intervals.intersect(x, y, 4).collect()], [(p[1], max(p[2], q[2]), min(p[3], q[3])) for p, q in hit])
    lies = [(p, q) for p in a for q in b if p[1] and p[1] == q[1] and q[2] <= p[2] < q[3]]
    for f in (x, x.drop("tag", "end"), x.select("chrom", "start")):
        of = [schema.split(", ").index(next(c for c in schema.split(", ") if c.startswith(n + " "))) for n in f.columns]
        assert same([(tuple(r.x), r.big.id) for r in intervals.assign(f, y, 4).collect()], [(tuple(p[i] for i in of), q[0]) for p, q in lies])
    many = spark.range(300).selectExpr("id", "CAST(char(120 + id DIV 1000) AS string) AS chrom", "id DIV 1000 AS start", "9L + id DIV 1000 AS end")
    listed = lambda: [intervals._listed(many, intervals.SPAN, n, intervals._under("start", "end", 16)) for n in "ab"]
    met = intervals._overlapping(*listed(), 16)
    assert met.count() > 1
    monkeypatch.setattr(intervals, "LISTED", 1 << 16)
    met = intervals._overlapping(*listed(), 16)
    assert met.count() == 1 and met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # rows are dealt once
    assert intervals.overlap_join(many, many, 4).count() == 90_000
