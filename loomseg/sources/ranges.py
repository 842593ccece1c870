"""Sequence files read by byte ranges, so that one file is the work of many tasks.

A range owns the records whose first byte lies in it. A task begins at the first line of its range and goes on to the first
record that is one for certain; it reads on past its end as far as its last record does. Records of FASTA may be as long as a
chromosome, so they come as pieces: a first pass counts each range's letters and headers, a prefix over one row a range tells where
each begins, and a second pass reads. Compressed files are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, letters of a piece of sequence, bytes read at once.
RANGE, PIECE, READ = 64 << 20, 1 << 20, 1 << 20
#: Records of a batch.
BATCH = 4096


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def planned(path: str, suffixes: tuple[str, ...], size: int) -> list[tuple[str, int, int, int, int]]:
    """(file, its number, range's number, begin, end) of a file, or of a folder's files with one of the suffixes."""
    fs, root = open_fs(path)
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(suffixes)]
    out = []
    for k, i in enumerate(sorted(found, key=lambda i: i.path)):
        step = max(1, i.size) if i.path.endswith((".gz", ".bz2")) else size
        out += [(head + i.path, k, r, a, min(a + step, i.size)) for r, a in enumerate(range(0, i.size, step))]
    return out


def ranges(spark: SparkSession, path: str, suffixes: tuple[str, ...], size: int) -> DataFrame:
    """A row a range; as many tasks as ranges, up to ten thousand."""
    rows = planned(path, suffixes, size)
    return spark.createDataFrame(rows, "file string, f long, r long, a long, b long").repartition(max(1, min(len(rows), 10_000)))


def _opened(file: str):
    fs, root = open_fs(file)
    if file.endswith((".gz", ".bz2")):
        return fs.open_input_stream(root, compression="detect"), False
    return fs.open_input_file(root), True


def lines(file: str, a: int) -> Iterator[tuple[int, bytes]]:
    """(position, line without its end) from the first line that begins at a or later."""
    f, seekable = _opened(file)
    with f:
        at = 0
        held = b""
        if seekable and a > 0:
            f.seek(a - 1)
            at, skip = a - 1, True
        else:
            skip = False
        while block := f.read(READ):
            held += block
            if skip:
                cut = held.find(b"\n")
                if cut < 0:
                    at, held = at + len(held), b""
                    continue
                at, held, skip = at + cut + 1, held[cut + 1 :], False
            parts = held.split(b"\n")
            held = parts.pop()
            for p in parts:
                yield at, p
                at += len(p) + 1
        if held and not skip:
            yield at, held


def fastq_records(file: str, a: int, b: int) -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual) of the records that begin in [a, b). A record begins with an @ whose line is followed, two lines on, by a +: a line of qualities may begin with @, but then bases stand there."""
    window: list[tuple[int, bytes]] = []
    source = lines(file, a)
    sure = a == 0
    last = a
    while True:
        while len(window) < 4:
            one = next(source, None)
            if one is None:
                break
            if window or one[1].strip():
                window.append((one[0], one[1].rstrip(b"\r")))
        if not window or window[0][0] >= b:
            return
        whole = len(window) == 4
        good = whole and window[0][1].startswith(b"@") and window[2][1].startswith(b"+") and len(window[1][1]) == len(window[3][1])
        if not good:
            if sure or (whole and window[0][1].startswith(b"@") and window[2][1].startswith(b"+")):
                raise ValueError(f"{file}: not a record of four lines at byte {window[0][0]}: {window[0][1][:80]!r}")
            if not whole:
                return  # the end of a record that an earlier range owns
            window.pop(0)
            continue
        sure, last = True, window[0][0]
        name, seq, _, qual = (w[1].decode() for w in window)
        yield name[1:].split()[0] if name[1:].split() else "", seq, qual
        window = []


def read_fastq(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(name, seq, qual) of records of four lines, of a file or a folder of *.fq and *.fastq. Blank lines between records are passed over; anything else is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple] = []
                for row in fastq_records(r["file"], r["a"], r["b"] if not r["file"].endswith((".gz", ".bz2")) else 1 << 62):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield _batch(rows, ["name", "seq", "qual"])
                        rows = []
                if rows:
                    yield _batch(rows, ["name", "seq", "qual"])

    return ranges(spark, path, (".fq", ".fastq", ".fq.gz", ".fastq.gz"), size).mapInArrow(run, "name string, seq string, qual string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string()) if None in c else pa.array(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _fasta_counts(file: str, a: int, b: int) -> tuple[int, int, str | None, int, int]:
    """Letters ahead of the range's first header, headers, the last one's name and position, and letters after it."""
    ahead, headers, name, at, after = 0, 0, None, -1, 0
    for pos, line in lines(file, a):
        if pos >= b:
            break
        if line.startswith(b">"):
            headers, name, at, after = headers + 1, _name(line), pos, 0
        elif headers:
            after += len(b"".join(line.split()))
        else:
            ahead += len(b"".join(line.split()))
    return ahead, headers, name, at, after


def _name(line: bytes) -> str:
    words = line[1:].split()
    return words[0].decode() if words else ""


def read_fasta_pieces(spark: SparkSession, path: str, suffix: str = "fa", size: int = RANGE, piece: int = PIECE) -> DataFrame:
    """(name, file, record, at, seq): pieces that don't cross a multiple of `piece` letters; at: the place of a piece's first letter in its record.

    record: the header's place in its file, so records of one name stay apart. Lines ahead of a file's first header are no record. A record without
    letters has no piece. Letters keep their case.
    """
    rows = ranges(spark, path, (f".{suffix}", ".fa", ".fasta"), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([(r["file"], r["f"], r["r"], r["a"], r["b"], *_fasta_counts(r["file"], r["a"], r["b"]))], ["file", "f", "r", "a", "b", "ahead", "headers", "name", "place", "after"])

    counts = rows.mapInArrow(count, "file string, f long, r long, a long, b long, ahead long, headers long, name string, place long, after long")
    # one row a range: the driver's plan of where each begins
    plan, last, state = [], None, (None, -1, 0)
    for r in sorted(counts.collect(), key=lambda r: (r.f, r.r)):
        if r.f != last:
            last, state = r.f, (None, -1, 0)
        plan.append((r.file, r.a, r.b, *state))
        state = (r["name"], r.place, r.after) if r.headers else (state[0], state[1], state[2] + r.ahead)
    schema = "file string, a long, b long, name string, record long, at long"
    begun = spark.createDataFrame(plan, schema).repartition(max(1, min(len(plan), 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for row in _pieces(r, piece):
                    yield _batch([row], ["name", "file", "record", "at", "seq"])

    return begun.mapInArrow(run, "name string, file string, record long, at long, seq string")


def _pieces(r: dict, piece: int) -> Iterator[tuple]:
    name, record, at = r["name"], r["record"], r["at"]
    held: list[bytes] = []
    n = 0

    def cut(everything: bool):
        nonlocal held, n, at
        text = b"".join(held)
        while text and (everything or len(text) >= piece - at % piece):
            part, text = text[: piece - at % piece], text[piece - at % piece :]
            yield name, r["file"], record, at, part.decode()
            at += len(part)
        held, n = [text], len(text)

    for pos, line in lines(r["file"], r["a"]):
        if pos >= r["b"]:
            break
        if line.startswith(b">"):
            yield from cut(True)
            name, record, at, held, n = _name(line), pos, 0, [], 0
        elif name is not None:
            letters = b"".join(line.split())
            held.append(letters)
            n += len(letters)
            if n >= 2 * piece:
                yield from cut(False)
    yield from cut(True)


def read_fasta(spark: SparkSession, path: str, suffix: str = "fa", size: int = RANGE) -> DataFrame:
    """(name, seq): whole records, put together from their pieces; those without letters are left out. A row holds 2 GB at most: longer records stay pieces."""
    pieces = read_fasta_pieces(spark, path, suffix, size)
    whole = pieces.groupBy("file", "record", "name").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("x"))
    return whole.select("name", F.concat_ws("", F.col("x.seq")).alias("seq"))


def sequence_under(regions: DataFrame, pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """regions (chrom, start, end, ...) with seq, the letters under each, from pieces: an equi-join on the pieces' places, so no task holds a whole sequence.

    What lies outside its sequence has no letters; regions on unknown sequences are left out, as are those with end <= start. Regions of several
    records of one name get each one's. piece: as the pieces were read.
    """
    names = regions.columns
    own = regions.groupBy(*names).agg(F.count("*").alias("_many"))
    low, high = F.greatest("start", F.lit(0)), F.col("end") - 1
    asked = own.where("end > start AND end > 0").withColumn("_k", F.explode(F.sequence(F.floor(low / piece), F.floor(high / piece))))
    given = pieces.select(F.col("name").alias("_n"), F.floor(F.col("at") / piece).alias("_g"), F.struct("file", "record").alias("_r"), F.col("at").alias("_at"), F.col("seq").alias("_s"))
    met = asked.join(given, (F.col("chrom") == F.col("_n")) & (F.col("_k") == F.col("_g")))
    first = F.greatest(low - F.col("_at"), F.lit(0))
    part = F.substring("_s", (first + 1).cast("int"), F.greatest(F.col("end") - F.greatest(low, F.col("_at")), F.lit(0)).cast("int"))
    parts = met.groupBy(*names, "_many", "_r").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), part.alias("s")))).alias("_x"))
    return parts.withColumn("seq", F.concat_ws("", F.col("_x.s"))).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_many")))).select(*names, "seq")
