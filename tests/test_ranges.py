"""Files read by ranges equal files read whole, for any range size."""

import random
import struct
import zlib

import pytest

from loomseg.sources import bam, ranges, text


def _fastq(rng, n):
    out, rows = [], []
    for i in range(n):
        k = rng.randrange(0, 30)
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(k)), "".join(rng.choice("@+!I>") for _ in range(k))
        rows.append((f"r{i}", seq, qual))
        out.append(f"@r{i} more words\n{seq}\n+{rng.choice(['', f'r{i}'])}\n{qual}\n")
    return "".join(out), rows


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_fastq_records_of_all_ranges(tmp_path, size, monkeypatch):
    monkeypatch.setattr(ranges, "READ", 50)
    whole, rows = _fastq(random.Random(size), 60)
    for ending, tail in ((whole, ""), (whole.rstrip("\n"), ""), (whole.replace("\n", "\r\n"), "")):
        f = tmp_path / "x.fq"
        f.write_bytes((ending + tail).encode())
        n = len(ending)
        got = [r for a in range(0, n, size) for r in ranges.fastq_records(str(f), a, min(a + size, n))]
        if ending is whole or rows[-1][2]:
            assert got == rows


def test_fastq(spark, tmp_path):
    whole, rows = _fastq(random.Random(9), 300)
    (tmp_path / "x.fq").write_text(whole)
    for size in (100, 1 << 20):
        got = ranges.read_fastq(spark, str(tmp_path / "x.fq"), size)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert text.detect_scale(got).first().scale == "phred33"
    for bad in ("@a\nAC\n+\nI\n", "a\nAC\n+\nII\n", "@a\nAC\n+\n"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception, match="not a record of four lines"):
            ranges.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def _fasta(rng, n):
    out, rows = ["; a comment\n"], []
    for i in range(n):
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 1, 50, 700])))
        out.append(f">s{i % 7} words\n")
        width = rng.randrange(5, 60)
        out += [seq[k : k + width] + rng.choice(["\n", "\r\n", " \n", "\n\n"]) for k in range(0, len(seq), width)]
        if seq:
            rows.append((f"s{i % 7}", seq))
    return "".join(out), rows


@pytest.mark.parametrize("size", [70, 400, 1 << 20])
def test_fasta(spark, tmp_path, size):
    whole, rows = _fasta(random.Random(size), 25)
    (tmp_path / "x.fa").write_bytes(whole.encode())
    (tmp_path / "y.fa").write_text(">other\nACG\n")
    assert sorted(map(tuple, ranges.read_fasta(spark, str(tmp_path / "x.fa"), size=size).collect())) == sorted(rows)
    assert sorted(map(tuple, ranges.read_fasta(spark, str(tmp_path), size=size).collect())) == sorted([*rows, ("other", "ACG")])
    pieces = ranges.read_fasta_pieces(spark, str(tmp_path / "x.fa"), size=size, piece=64).collect()
    assert all(len(p.seq) and p["at"] // 64 == (p["at"] + len(p.seq) - 1) // 64 for p in pieces)


def test_sequence_under_regions(spark, tmp_path):
    rng = random.Random(4)
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 200))) for i in range(5)}
    (tmp_path / "x.fa").write_text("".join(f">{n}\n{s[:50]}\n{s[50:]}\n" for n, s in seqs.items()))
    rows = [(f"s{rng.randrange(6)}", a := rng.randrange(-5, 200), a + rng.randrange(-2, 90), i % 40) for i in range(100)]
    rows += rows[:3]
    regions = spark.createDataFrame(rows, "chrom string, start long, end long, tag int")
    got = ranges.sequence_under(regions, ranges.read_fasta_pieces(spark, str(tmp_path / "x.fa"), size=40, piece=16), 16).collect()
    want = []
    for c, a, b, t in rows:
        if c in seqs and b > a and max(a, 0) // 16 <= (len(seqs[c]) - 1) // 16 and b > 0:
            want.append((c, a, b, t, seqs[c][max(a, 0) : b]))
    assert sorted(map(tuple, got)) == sorted(want)


def _bam(rng, n, most):
    """A file of blocks of up to `most` bytes, and what it holds."""
    raw = b"BAM\1" + struct.pack("<i", 5) + b"@HD\tx" + struct.pack("<i", 2)
    for name, size in ((b"c1\0", 100_000), (b"c2\0", 5000)):
        raw += struct.pack("<i", len(name)) + name + struct.pack("<i", size)
    names = []
    for i in range(n):
        name, k = f"read.{i}", rng.choice([0, 1, 5, 40, 600])
        cigar = struct.pack("<I", k << 4) if k else b""
        body = struct.pack("<iiBBHHHiiii", rng.choice([-1, 0, 1]), rng.randrange(-1, 5000), len(name) + 1, rng.randrange(60), 0, len(cigar) // 4, rng.randrange(2048), k, -1, -1, 0)
        body += name.encode() + b"\0" + cigar + rng.randbytes((k + 1) // 2) + bytes(rng.randrange(40) for _ in range(k)) + b"NMC" + bytes([i % 9])
        raw += struct.pack("<i", len(body)) + body
        names.append(name)
    out, at = b"", 0
    while at < len(raw) or not out.endswith(b"\0" * 9):
        part = raw[at : at + rng.randrange(0, most)]
        at += len(part)
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC\2\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
        if at >= len(raw):
            break
    return out, names


@pytest.mark.parametrize("seed,most", [(1, 60), (2, 500), (3, 5000), (4, 60_000)])
def test_binary_ranges(tmp_path, seed, most):
    out, names = _bam(random.Random(seed), 200, most)
    f = tmp_path / "x.bam"
    f.write_bytes(out)
    every = lambda *_: True
    with open(f, "rb") as one:
        whole = list(bam.records(one, every))
    assert [r[0] for r in whole] == names
    for size in (101, 997, 20_000, 1 << 20):
        got = []
        for a in range(0, len(out), size):
            with open(f, "rb") as one:
                got += bam.records(one, every, a, min(a + size, len(out)), len(out))
        assert got == whole, size


def test_binary_source_by_ranges(spark, tmp_path):
    out, names = _bam(random.Random(7), 300, 3000)
    (tmp_path / "x.bam").write_bytes(out)
    bam.register(spark)
    df = spark.read.format("bam").option("rangeBytes", "5000").option("path", str(tmp_path / "x.bam")).load()
    assert df.rdd.getNumPartitions() > 3
    assert sorted(r.qname for r in df.collect()) == sorted(names)
