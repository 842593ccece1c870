"""Genotype likelihoods against the formulas, one base at a time."""

import math
import random

import numpy as np
import pytest

from loomseg.operators import calling
from loomseg.operators.calling import alleles, base_counts, genotype_likelihoods, likelihoods

SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, who string"


def _tail(n, k, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def _formula(bases):
    """bases: (base, q, strand) of each read."""
    n = len(bases)
    own, cost, seen = [0] * 5, [0.0] * 5, {}
    for b, q, s in sorted(bases, key=lambda x: (x[1], x[2], x[0]), reverse=True):
        p = 10 ** (-q / 10)
        w = seen.get((s, b), 0)
        cost[b] += (0.83**w * 0.97 + 0.03) * -10 * math.log10(_tail(n, own[b] + 1, p) / _tail(n, own[b], p))
        own[b] += 1
        seen[s, b] = w + 1
    out = np.zeros((5, 5))
    for j in range(5):
        for k in range(5):
            out[j, k] = sum(c for i, c in enumerate(cost) if i not in (j, k))
            if j != k:
                out[j, k] -= 4.343 * math.log(math.comb(own[j] + own[k], own[j]) / 2 ** (own[j] + own[k]))
    return np.maximum(out, 0)


@pytest.mark.parametrize("n", [1, 2, 9, 60, 400])
def test_likelihoods(n):
    rng = random.Random(n)
    bases = [(rng.choice([0, 0, 0, 1, 2, 4]), rng.choice([4, 13, 20, 30]), rng.randrange(2)) for _ in range(n)]
    cells = {b: bases.count(b) for b in set(bases)}
    b, q, s = (np.array(x) for x in zip(*cells))
    assert likelihoods(b, q, s, np.array(list(cells.values()))) == pytest.approx(_formula(bases), rel=1e-6, abs=1e-6)


def test_a_deep_position_is_counted_whole():
    p = likelihoods(np.array([0, 1]), np.array([30, 30]), np.array([0, 1]), np.array([200_000, 200_000]))
    assert np.isfinite(p).all() and p.argmin() == 1  # half A, half C


def test_alleles():
    assert alleles([50, 0, 90, 0], 0) == ([0, 2, 3], True)
    assert alleles([50, 20, 90, 10], 0) == ([0, 2, 1, 3], False)
    assert alleles([50, 20, 90, 20], 4) == ([4, 2, 0, 3, 1], False)
    assert alleles([0, 0, 0, 0], 4) == ([4, 3], True)


def test_counts_and_calls(spark):
    reads = [
        ("a", 0, "c", 2, 60, "2M1D2M", "ACGT", "IIII", "x"), ("b", 16, "c", 2, 10, "1S4M", "NACG=", "I#III", "y"), ("c", 0, "c", 3, 255, "2M1I1M", "CCAT", "IIII", "x"),
        ("d", 4, "c", 2, 60, "4M", "AAAA", "IIII", "x"), ("e", 0, "c", 2, 60, "4M", None, None, "x"), ("f", 0, "none", 0, 60, "1M", "G", "I", None),
    ]
    sam = spark.createDataFrame(reads, SAM)
    cells = {(r.sample, r.rname, r.pos, r.base, r.q, r.strand): r.n for r in base_counts(sam, sample="who").collect()}
    assert cells == {
        ("x", "c", 2, 0, 40, 0): 1, ("x", "c", 3, 1, 40, 0): 1, ("x", "c", 5, 2, 40, 0): 1, ("x", "c", 6, 3, 40, 0): 1,
        ("y", "c", 2, -1, 0, 0): 1, ("y", "c", 3, 1, 10, 1): 1, ("y", "c", 4, 2, 10, 1): 1, ("y", "c", 5, 5, 10, 1): 1,
        ("x", "c", 3, 1, 20, 0): 1, ("x", "c", 4, 1, 20, 0): 1, ("x", "c", 5, 3, 20, 0): 1, ("", "none", 0, 2, 40, 0): 1,
    }
    pieces = spark.createDataFrame([("c", 0, "AAacg"), ("c", 5, "Tnnnn")], "name string, at long, seq string")
    got = {(r.rname, r.pos, r.sample): r for r in genotype_likelihoods(base_counts(sam, sample="who"), pieces).collect()}
    assert set(got) == {("c", 2, "x"), ("c", 3, "x"), ("c", 3, "y"), ("c", 4, "x"), ("c", 4, "y"), ("c", 5, "x"), ("c", 5, "y"), ("c", 6, "x"), ("none", 0, "")}
    assert (got["c", 2, "x"].ref, got["c", 2, "x"].alts) == ("A", "X") and got["c", 2, "x"].pl[0] == 0
    assert (got["c", 3, "x"].ref, got["c", 3, "x"].alts, got["c", 3, "x"].depth) == ("C", "X", 2)
    assert (got["c", 5, "y"].ref, got["c", 5, "y"].alts) == ("T", "G,X") and got["c", 5, "y"].pl[0] == 0  # = is the reference's T
    assert got["none", 0, ""].ref == "N" and got["none", 0, ""].alts == "G,X"
    assert all(min(r.pl) == 0 and max(r.pl) <= 255 for r in got.values())
    assert genotype_likelihoods(base_counts(sam.limit(0)), pieces).count() == 0


def test_places_and_depths_make_no_difference(spark, monkeypatch):
    rng = random.Random(4)
    cigars = ["9M", "3M2D4M2S", "2S5M3N2M", "4M1I2M1D2M", "2H9M"]
    reads = [(f"r{i}", rng.choice([0, 16, 4]), rng.choice(["c", "d", None]), rng.choice([3, 3, 5, 30, 61, None]), rng.choice([5, 40, 255, None]), rng.choice(cigars), "".join(rng.choice("ACGTN=a") for _ in range(9)), "".join(rng.choice("#5?I") for _ in range(9)), rng.choice("xy")) for i in range(300)]
    sam = spark.createDataFrame(reads, SAM)
    pieces = spark.createDataFrame([("c", 0, "ACGTN" * 10), ("d", 0, "GATTACA" * 12)], "name string, at long, seq string")
    ordered = lambda rows: sorted(rows, key=str)
    counts = ordered(base_counts(sam, sample="who").collect())
    calls = ordered(genotype_likelihoods(base_counts(sam, sample="who"), pieces).collect())
    assert sum(r.n for r in counts) > 1000 and any(r.pos is None for r in counts)
    for place, deep, met in ((4, 1 << 22, 1 << 16), (8, 20, 2)):
        for k, v in (("PLACE", place), ("DEEP", deep), ("MET", met), ("AT_ONCE", 40)):
            monkeypatch.setattr(calling, k, v)
        assert ordered(base_counts(sam, sample="who").collect()) == counts
        assert ordered(calling.genotypes(sam, pieces, sample="who").collect()) == calls


def test_deep_positions_share_their_costs(monkeypatch):
    """A table for each number of bases and quality, not for each position."""
    rng = np.random.default_rng(5)
    units, cells = 300, 60
    unit = np.repeat(np.arange(units), cells)
    base, q, strand = (np.tile(x, units) for x in np.unravel_index(rng.choice(5 * 37 * 2, cells, replace=False), (5, 37, 2)))
    n, made, whole = rng.integers(3, 6, units * cells), [], calling._costs
    monkeypatch.setattr(calling, "_costs", lambda q, n: made.append(len(n)) or whole(q, n))
    own, cost = calling._sums(unit, units, base, q + 4, strand, n)
    assert sum(made) == len(set(zip(np.bincount(unit, n)[unit].tolist(), q.tolist()))) < units * 37
    p = calling._genotypes(own, cost)
    for u in (0, 299):
        at = unit == u
        bases = [x for b, y, s, m in zip(base[at], q[at] + 4, strand[at], n[at]) for x in [(b, y, s)] * m]
        assert p[u] == pytest.approx(_formula(bases), rel=1e-6, abs=1e-6)


def test_code_of_bases_is_fixed():
    assert calling.BASES == "ACGT"
