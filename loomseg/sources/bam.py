"""Binary alignments as a Spark data source: BGZF blocks are gzip members, records are parsed from the stream of their bytes.

A file is read by ranges of compressed bytes. A range owns the records that begin in a block whose first byte lies in it: it looks for the first block by its
header, and in that for the first record by a chain of records that could be ones. A file of plain gzip members is one range.
Predicates on rname, flag and mapq are tested on a record's fixed part, and records that fail are not parsed further.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
# Fixed values of the format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in BASES for b in BASES]


#: Compressed bytes of a range, by default.
RANGE = 64 << 20
#: A block's header: the gzip magic with an extra field, which holds the block's size under BC.
_MAGIC, _MOST = b"\x1f\x8b\x08\x04", 1 << 16
#: Records that must follow each other where a range looks for its first.
CHAIN = 5


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with `head` (18 bytes are enough); 0 if it is none."""
    if len(head) < 18 or head[:4] != _MAGIC or head[12:16] != b"BC\2\0":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


class _Members:
    """Plain gzip members, one after the other: all of them are the block at 0."""

    def __init__(self, f, at: int):
        self.f, self.z, self.tail = f, zlib.decompressobj(31), b""

    def next(self) -> tuple[int, bytes] | None:
        while data := self.tail or self.f.read(1 << 18):
            self.tail = b""
            out = self.z.decompress(data)
            if self.z.eof:
                self.tail, self.z = self.z.unused_data, zlib.decompressobj(31)
            if out:
                return 0, out
        return None


class _Blocks:
    """Blocks from a place on: where each begins, and its bytes."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def next(self) -> tuple[int, bytes] | None:
        while True:
            self.f.seek(self.at)
            head = self.f.read(18)
            if not head:
                return None
            n = block_size(head)
            if not n:
                raise ValueError(f"no block at byte {self.at}")
            at, self.at = self.at, self.at + n
            out = zlib.decompress(head + self.f.read(n - 18), 31)
            if out:
                return at, out


class _Stream:
    """The bytes of successive blocks, and of each place the block that it is in."""

    def __init__(self, source):
        self.source, self.data, self.pos, self.starts = source, bytearray(), 0, []

    def more(self) -> bool:
        if (one := self.source.next()) is None:
            return False
        self.starts.append((len(self.data), one[0]))
        self.data += one[1]
        return True

    def has(self, n: int) -> bool:
        """Whether n bytes follow."""
        while len(self.data) - self.pos < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        self.has(n)
        out = bytes(self.data[self.pos : self.pos + n])
        self.pos += n
        if self.pos > 1 << 20:
            k = max(0, bisect_right(self.starts, (self.pos, 1 << 62)) - 1)
            self.starts = [(at - self.pos, c) for at, c in self.starts[k:]]
            del self.data[: self.pos]
            self.pos = 0
        return out

    def block(self) -> int | None:
        """Where the block begins that holds the next byte; None at the end."""
        if not self.has(1):
            return None
        return self.starts[bisect_right(self.starts, (self.pos, 1 << 62)) - 1][1]


def _header(s: _Stream) -> tuple[list[str], list[int]]:
    """Names and lengths of the references; s then stands at the first record."""
    if s.take(4) != b"BAM\1":
        raise ValueError("not a binary alignment file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names, sizes = [], []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        sizes.append(struct.unpack("<i", s.take(4))[0])
    return names, sizes


def _possible(s: _Stream, at: int, sizes: list[int]) -> int | None:
    """The end of a record that could begin at a place of the stream; None if none could; -1 at the stream's very end."""
    s.pos = at
    if not s.has(1):
        return -1
    if not s.has(36):
        return None
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", s.data, at)
    inside = lambda t, p: -1 <= t < len(sizes) and -1 <= p and (t < 0 or p <= sizes[t])
    if not (32 < size < 1 << 28 and l_name and l_seq >= 0 and inside(tid, pos) and inside(mtid, mpos) and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size):
        return None
    if not s.has(36 + l_name):
        return None
    name = s.data[at + 36 : at + 36 + l_name]
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    return at + 4 + size if s.has(4 + size) else None


def _first_record(s: _Stream, sizes: list[int], upto: int) -> bool:
    """Moves s to the first record of its blocks; False if none begins in a block ahead of `upto`."""
    at = 0
    while True:
        s.pos = at
        block = s.block()
        if block is None or block >= upto:
            return False
        end = at
        for _ in range(CHAIN):
            end = _possible(s, end, sizes)
            if end is None or end < 0:
                break
        if end is not None and end != at:
            s.pos = at
            return True
        at += 1


def _first_block(f, a: int, size: int) -> int | None:
    """Where the first block at a or later begins."""
    f.seek(a)
    data = f.read(2 * _MOST + 36)
    at = data.find(_MAGIC)
    while at >= 0:
        n = block_size(data[at : at + 18])
        f.seek(min(a + at + n, size))
        if n and (a + at + n == size or block_size(f.read(18))):
            return a + at
        at = data.find(_MAGIC, at + 1)
    return None


def records(f, wanted, a: int = 0, b: int = 1 << 62, size: int = 0) -> Iterator[tuple]:
    """Rows of the records that begin in blocks of [a, b); wanted: a test of (rname, flag, mapq)."""
    blocked = block_size(f.read(18)) > 0
    f.seek(0)
    s = _Stream((_Blocks if blocked else _Members)(f, 0))
    names, sizes = _header(s)
    if a > 0:
        at = _first_block(f, a, size) if blocked else None
        if at is None or at >= b:
            return
        s = _Stream(_Blocks(f, at))
        if not _first_record(s, sizes, b):
            return
    name = lambda i: names[i] if 0 <= i < len(names) else "*"
    while (block := s.block()) is not None and block < b and len(head := s.take(4)) == 4:
        r = s.take(struct.unpack("<i", head)[0])
        tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
        if not wanted(name(tid), flag, mapq):
            continue
        at = 32 + l_name
        cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", r, at)) or "*"
        at += 4 * n_cigar
        seq = "".join(_PAIRS[x] for x in r[at : at + (l_seq + 1) // 2])[:l_seq] or "*"
        at += (l_seq + 1) // 2
        q = r[at : at + l_seq]
        qual = "*" if not q or q[0] == 255 else bytes(c + 33 for c in q).decode()
        yield r[32 : 32 + l_name - 1].decode(), flag, name(tid), pos, mapq, cigar, "=" if mtid == tid and tid >= 0 else name(mtid), mpos, tlen, seq, qual


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tests, self.size = options["path"], [], int(options.get("rangeBytes", RANGE))

    def pushFilters(self, filters):
        for f in filters:
            col = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and col in ("rname", "flag", "mapq"):
                self.tests.append((("rname", "flag", "mapq").index(col), "eq", f.value))
            elif isinstance(f, GreaterThanOrEqual) and col == "mapq":
                self.tests.append((2, "ge", f.value))
            else:
                yield f

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path if ":/" in self.path else "file://" + self.path)

    def partitions(self):
        fs, root = self._fs()
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".bam")]
        return [InputPartition((i.path, a, min(a + self.size, i.size), i.size)) for i in files for a in range(0, i.size, self.size)]

    def read(self, partition):
        def wanted(*x) -> bool:
            return all(x[i] == v if how == "eq" else x[i] >= v for i, how, v in self.tests)

        types = [pa.int32() if " int" in f else pa.string() for f in SCHEMA.split(", ")]
        fs, _ = self._fs()
        rows = []
        path, a, b, size = partition.value
        with fs.open_input_file(path) as f:
            for r in records(f, wanted, a, b, size):
                rows.append(r)
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)


class BamDataSource(DataSource):
    """spark.read.format("bam").load(path); option rangeBytes: compressed bytes of a task."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)
