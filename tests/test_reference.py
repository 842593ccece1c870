"""Mismatch strings and alignment qualities against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest

from loomseg.operators import reference
from loomseg.operators.reference import alignment_qualities, mismatches, posteriors, with_reference

SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"
KNOWN = set("ACMGRSVTWYHKDB")


def _reads(rng, refs, n):
    out = []
    for i in range(n):
        ops = []
        if rng.random() < 0.4:
            ops.append((rng.randrange(1, 5), "S"))
        ops.append((rng.randrange(1, 40), rng.choice("M=X") if rng.random() < 0.1 else "M"))
        for _ in range(rng.randrange(3)):
            ops += [(rng.randrange(1, 4), rng.choice("IDDN")), (rng.randrange(1, 30), "M")]
        if rng.random() < 0.3:
            ops.append((rng.randrange(1, 5), "S"))
        k = sum(m for m, o in ops if o in "MIS=X")
        name = rng.choice([*refs, "none"])
        pos = rng.randrange(0, 330)
        letters = refs.get(name, "")[pos : pos + k].upper().ljust(k, "A")
        seq = "".join(c if rng.random() < 0.7 else rng.choice("ACGTN=R") for c in letters)
        out.append((f"q{i}", 4 if rng.random() < 0.05 else 0, name, pos, 30, "".join(f"{m}{o}" for m, o in ops), seq, "".join(rng.choice("#5?I") for _ in range(k))))
    return out + out[:2]


def _md(read, refs):
    _, flag, name, pos, _, cigar, seq, _ = read
    if flag & 4 or name not in refs or pos >= len(refs[name]):
        return None, None, None
    ref, x, y, u, nm, md, shown = refs[name], pos, 0, 0, 0, "", list(seq)
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)(\D)", cigar)):
        if op in "M=X":
            stop = False
            for j in range(n):
                if x + j >= len(ref):
                    stop = True
                    break
                a, b = seq[y + j].upper(), ref[x + j].upper()
                if a == "=" or (a == b and a in KNOWN):
                    u += 1
                    shown[y + j] = "="
                else:
                    md, u, nm = f"{md}{u}{ref[x + j]}", 0, nm + 1
            if stop:
                break
            x, y = x + n, y + n
        elif op == "D":
            md, u = f"{md}{u}^{ref[x : x + n]}", 0
            if x + n > len(ref):
                break
            x, nm = x + n, nm + n
        elif op in "IS":
            y, nm = y + n, nm + (n if op == "I" else 0)
        elif op == "N":
            x += n
    return f"{md}{u}", nm, "".join(shown)


@pytest.mark.parametrize("tile,margin", [(1024, 1024), (32, 16), (64, 200)])
def test_mismatches(spark, monkeypatch, tile, margin):
    for f in ("tiles", "with_reference"):
        monkeypatch.setattr(getattr(reference, f), "__defaults__", (tile, margin) if f == "tiles" else (0, 0, tile, margin))
    rng = random.Random(tile)
    refs = {n: "".join(rng.choice("ACGTacgtN") for _ in range(k)) for n, k in (("a", 330), ("b", 350), ("c", 1))}
    pieces = [(n, i, s[i : i + 37]) for n, s in refs.items() for i in range(0, len(s), 37)]
    reads = _reads(rng, refs, 150)
    got = mismatches(spark.createDataFrame(reads, SAM), spark.createDataFrame(pieces, "name string, at long, seq string")).collect()
    assert sorted((r.qname, r.md, r.nm, r.equal_seq) for r in got) == sorted(((r[0], *_md(r, refs)) for r in reads), key=str)


def test_mismatches_run_read_by_read_beside_the_join(spark):
    """No fold over letters in the plan: it took most of the time."""
    refs = {"a": "ACGTACGTAC"}
    pieces = spark.createDataFrame([("a", 0, refs["a"])], "name string, at long, seq string")
    reads = [("q1", 0, "a", 2, 30, "2M1D3M2S", "GTCGAAA", "IIIIIII"), ("q2", 4, "a", 2, 30, "2M", "GT", "II"), ("q3", 0, "a", 8, 30, "4M", "ACGT", "IIII"), ("q4", 0, "a", 3, 30, "3M", "T=G", "III")]
    found = mismatches(spark.createDataFrame(reads, SAM), pieces)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
    got = {r.qname: (r.md, r.nm, r.equal_seq) for r in found.collect()}
    assert got == {r[0]: _md(r, refs) for r in reads} and got["q3"] == ("2", 0, "==GT")
    noseq = reference._mismatch([(2, "D"), (3, "S")], None, "ACGT"), reference._mismatch([(2, "M")], None, "ACGT")
    assert noseq == (("0^AC0", 2, None), (None, None, None))


def test_with_reference(spark):
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(500))
    pieces = spark.createDataFrame([("a", i, seq[i : i + 50]) for i in range(0, 500, 50)], "name string, at long, seq string")
    reads = [(f"q{i}", 0, "a", p, 0, f"{n}M", "", "") for i, (p, n) in enumerate([(0, 3), (10, 300), (499, 1), (490, 40), (70, 64), (200, 150)])]
    for tile, margin in ((1024, 1024), (32, 16)):
        got = with_reference(spark.createDataFrame(reads, SAM), pieces, 5, 9, tile, margin).collect()
        for r in got:
            assert r.ref_at == max(0, r.pos - 5) and r.ref == seq[r.ref_at : r.pos + int(r.cigar[:-1]) + 9]


def test_tiles_are_not_broadcast(spark):
    """Files may be small beside the tiles made of them."""
    pieces = spark.range(400).selectExpr("CAST(char(97 + id DIV 1000) AS string) AS name", "id * 50 AS at", "repeat('ACGTA', 10) AS seq")
    reads = [(f"q{i}", 0, "a", 2000 + i % 7, 0, "60M", "A" * 60, "I" * 60) for i in range(100)] + [("long", 0, "a", 5, 0, "3000M", "A", "I")]
    for sam in (reads[:-1], reads):
        found = with_reference(spark.createDataFrame(sam, SAM), pieces, tile=1024, margin=1024)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [rname" not in plan and "SortMergeJoin [rname" in plan
        assert len(found.filter("ref = substring(repeat('ACGTA', 4000), pos + 1, length(ref))").collect()) == len(sam)


def test_reads_that_meet_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(reference, "MET", 3)
    test_with_reference(spark)


def _enumerated(ref, read, qual):
    """Weights of all paths, by (letter, place, kind)."""
    L, n = len(ref), len(read)
    end = 1 / (2 * n + 2)
    d, e = reference.OPEN, reference.EXTEND
    go = {("M", "M"): (1 - 2 * d) * (1 - end), ("M", "I"): d * (1 - end), ("M", "D"): d * (1 - end), ("I", "M"): (1 - e) * (1 - end), ("I", "I"): e * (1 - end), ("D", "M"): 1 - e, ("D", "D"): e}
    err = [10 ** (-q / 10) for q in qual]

    def emit(i, k):
        a, b = ref[k], read[i]
        return 1.0 if a > 3 or b > 3 else 1 - err[i] if a == b else err[i] / 3

    total = {}

    def walk(i, k, kind, weight, path):
        if i == n - 1 and kind != "D":
            for p in path:
                total[p] = total.get(p, 0) + weight * end
        if kind != "I" and (kind, "D") in go and k + 1 < L and i > 0:
            walk(i, k + 1, "D", weight * go[kind, "D"], path)
        if i + 1 < n:
            if k + 1 < L:
                walk(i + 1, k + 1, "M", weight * go[kind, "M"] * emit(i + 1, k + 1), [*path, (i + 1, k + 1, False)])
            if kind != "D":
                walk(i + 1, k, "I", weight * go[kind, "I"] * 0.25, [*path, (i + 1, k, True)])

    for k in range(L):
        walk(0, k, "M", (1 - d) / L * emit(0, k), [(0, k, False)])
        walk(0, k, "I", d / L * 0.25, [(0, k, True)])
    return total


@pytest.mark.parametrize("seed", range(6))
def test_posteriors_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    sizes = rng.integers(1, 6, 4)
    refs = np.full((4, sizes.max()), 4)
    for j, k in enumerate(sizes):
        refs[j, :k] = rng.integers(0, 5, k)
    reads, quals = rng.integers(0, 5, (4, n)), rng.integers(2, 41, (4, n))
    state, inserted, best = posteriors(refs, sizes, reads, quals, np.full(4, 20))
    for j in range(4):
        total = _enumerated(refs[j, : sizes[j]].tolist(), reads[j].tolist(), quals[j].tolist())
        for i in range(n):
            own = {(k, x): w for (a, k, x), w in total.items() if a == i}
            assert best[j, i] == pytest.approx(max(own.values()) / sum(own.values()), rel=1e-9)
            assert own[state[j, i], bool(inserted[j, i])] == pytest.approx(max(own.values()), rel=1e-9)


def test_alignment_qualities(spark):
    rng = random.Random(8)
    refs = {n: "".join(rng.choice("ACGT") for _ in range(400)) for n in "ab"}
    pieces = spark.createDataFrame([(n, i, s[i : i + 37]) for n, s in refs.items() for i in range(0, len(s), 37)], "name string, at long, seq string")
    s = refs["a"]
    exact = ("exact", 0, "a", 100, 30, "60M", s[100:160], "I" * 60)
    shifted = ("shifted", 0, "a", 100, 30, "30M2D30M", s[100:160], "I" * 60)  # an alignment with a gap that the letters don't ask for
    reads = [exact, shifted, *_reads(rng, refs, 60), ("short", 0, "a", 5, 0, "9M", "ACG", "III"), ("nothing", 0, "a", 5, 0, None, None, None)]
    for extended in (False, True):
        got = {r.qname: r for r in alignment_qualities(spark.createDataFrame(reads, SAM), pieces, extended).collect()}
        assert len(got) == len(reads) - 2
        assert got["exact"].bq[5:55] == "@" * 50 and got["exact"].capped[5:55] == "I" * 50
        assert set(got["shifted"].capped[34:]) == {"!"}
        for r in got.values():
            none = r.rname not in refs or (r.pos or 0) >= 400 or r.flag & 4 or "N" in (r.cigar or "N") or r.qname == "short"
            assert (r.bq is None) == bool(none)
            if r.bq:
                assert all(ord(q) - (ord(b) - 64) == ord(c) and c <= q for q, b, c in zip(r.qual, r.bq, r.capped, strict=True))


def test_window_of_a_read():
    assert reference._window([(5, "S"), (20, "M")], 100, 25) == (92, 123, 7)
    assert reference._window([(10, "M"), (3, "N"), (10, "M")], 1, 20) is None
    assert reference._window([(10, "M"), (20, "D"), (10, "M")], 100, 20)[2] == 23
    assert list(itertools.islice(iter([reference._window([(4, "I")], 0, 4)]), 1)) == [None]
