"""WARC archives as a Spark data source.

Reading: file partitions are packed to a target size; predicates on the record type and on headers are pushed to the
reader, which parses a record's headers first and skips a payload that nothing asks for without decoding it. Records are gzip
members of their own; those written here carry the `sl` extra field with the member's length, so that skipping one is a seek.
Writing: each task writes files of its own; the commit lists them in a manifest, so what a lost task left is not read. Overwriting removes older files at the commit.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .shared import bounded_batches, fresh_path, open_fs, stored

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Column -> WARC header.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
NAMES = [*HEADERS, "payload"]
MANIFEST = "_manifest"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field `sl` has the member's and the data's length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    total = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict, payload: bytes) -> bytes:
    """One WARC record: a response holds an HTTP block with the payload, a revisit the HTTP headers only."""
    length = len(payload) if fields.get("payload_length") is None else fields["payload_length"]
    block = _HTTP % length + (b"" if fields["record_type"] == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Date: {_DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    lines += [f"{h}: {' '.join(str(fields[c]).split())}" for c, h in HEADERS.items() if fields.get(c) is not None]
    if fields["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Bytes:
    """Reads forward in a gzip or plain archive, record by record, decoding no more than is asked for."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at = f, size, 0

    def records(self) -> Iterator[_Record]:
        while self.at < self.size:
            self.f.seek(self.at)
            head = self.f.read(24)
            if head[:2] == b"\x1f\x8b":
                known = head[3] == 4 and len(head) == 24 and head[12:14] == b"sl"
                r = _Member(self.f, self.at, struct.unpack("<I", head[16:20])[0] if known else None)
            elif head.strip(b"\r\n") == b"":
                self.at += len(head)
                continue
            elif b"WARC/" in head:
                r = _Plain(self.f, self.at + head.index(b"WARC/"))
            else:
                raise ValueError(f"no WARC record at byte {self.at}")
            yield r
            self.at = r.end()


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if sep:
            out[k.strip().lower()] = v.strip()
    return out


class _Record:
    def headers(self) -> dict[str, str]:
        raise NotImplementedError

    def block(self) -> bytes:
        raise NotImplementedError

    def end(self) -> int:
        raise NotImplementedError


class _Member(_Record):
    """A record that is a gzip member; without a known length its end is found by decoding it."""

    def __init__(self, f, at: int, length: int | None):
        self.f, self.at, self.length = f, at, length
        self.z, self.read, self.data, self.stop = zlib.decompressobj(31), at, b"", None

    def _more(self, want: int) -> bool:
        """Decodes up to `want` further bytes; False at the member's end."""
        while not self.z.eof:
            feed = self.z.unconsumed_tail
            if not feed:
                self.f.seek(self.read)
                feed = self.f.read(1 << 16)
                self.read += len(feed)
                if not feed:
                    raise ValueError(f"archive ends within the record at byte {self.at}")
            got = self.z.decompress(feed, want)
            self.data += got
            if self.z.eof:
                self.stop = self.read - len(self.z.unused_data)
            if got:
                return True
        return False

    def headers(self) -> dict[str, str]:
        while b"\r\n\r\n" not in self.data and self._more(4096):
            pass
        self.head = self.data.index(b"\r\n\r\n") + 4
        return _parse(self.data[: self.head])

    def block(self) -> bytes:
        parts, self.data = [self.data[self.head :]], b""
        while self._more(1 << 20):
            parts.append(self.data)
            self.data = b""
        return b"".join(parts)[:-4]

    def end(self) -> int:
        if self.length is not None:
            return self.at + self.length
        while self._more(1 << 20):
            self.data = b""
        return self.stop


class _Plain(_Record):
    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def headers(self) -> dict[str, str]:
        data = b""
        self.f.seek(self.at)
        while b"\r\n\r\n" not in data:
            more = self.f.read(4096)
            if not more:
                raise ValueError(f"archive ends within the headers at byte {self.at}")
            data += more
        self.head = self.at + data.index(b"\r\n\r\n") + 4
        found = _parse(data[: self.head - self.at - 4])
        self.long = int(found.get("content-length", 0))
        return found

    def block(self) -> bytes:
        self.f.seek(self.head)
        return self.f.read(self.long)

    def end(self) -> int:
        if not hasattr(self, "head"):
            self.headers()
        return self.head + self.long + 4


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]

    def __post_init__(self):
        self.value = None


def _files(path: str) -> list[tuple[str, int]]:
    """The archives under a path with their sizes: those that commits name, or all .warc and .warc.gz files."""
    fs, root = open_fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File}
    listed = [p for p in found if p.rpartition("/")[2].startswith(MANIFEST)]
    if listed:
        names = [n for p in listed for n in json.loads(fs.open_input_file(p).read())]
        return sorted((f"{root}/{n}", found[f"{root}/{n}"]) for n in names)
    return sorted((p, n) for p, n in found.items() if p.endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 32 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, tuple, str]] = []

    def pushFilters(self, filters):
        """Takes equality, IN and prefix tests of header columns; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in HEADERS or column == "payload_length":
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, (f.value,), "in"))
            elif isinstance(f, In):
                self.tests.append((column, tuple(f.value), "in"))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, (f.value,), "starts"))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, (), "set"))
            else:
                yield f

    def partitions(self):
        out, now, total = [], [], 0
        for p, n in _files(self.path):
            if now and total + n > self.split:
                out.append(Files(now))
                now, total = [], 0
            now.append((p, n))
            total += n
        return [*out, Files(now)] if now or not out else out

    def _passes(self, h: dict[str, str]) -> bool:
        for column, values, how in self.tests:
            v = h.get(HEADERS[column].lower())
            if v is None or (how == "in" and v not in values) or (how == "starts" and not v.startswith(values[0])):
                return False
        return True

    def read(self, partition):
        fs, _ = open_fs(self.path)
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows, held = [], 0

        def batch():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], NAMES)

        for path, size in partition.paths:
            with fs.open_input_file(path) as f:
                for r in _Bytes(f, size).records():
                    h = r.headers()
                    if not self._passes(h):
                        continue
                    v = [h.get(x.lower()) for x in HEADERS.values()]
                    v[5] = int(v[5]) if v[5] is not None else None
                    body = None
                    if self.payload and v[1] != "revisit":
                        body = r.block()
                        if h.get("content-type", "").startswith("application/http"):
                            body = body.partition(b"\r\n\r\n")[2]
                    rows.append((*v, body))
                    held += len(body or b"") + 500
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.roll, self.overwrite = options["path"], int(options.get("rollbytes", 64 << 20)), overwrite
        self.level = int(options.get("level", 4))

    def write(self, iterator):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                v = {n: c[i].as_py() for n, c in cols.items()}
                if out is None or size > self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(v, v.get("payload") or b""), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names = [n for m in messages if m for n in m.names]
        manifest = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/{manifest}") as f:
            f.write(json.dumps(names).encode())
        if self.overwrite:  # only now, so that a job that fails loses nothing
            own = {f"{root}/{n}" for n in [*names, manifest]}
            for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                if i.type == pafs.FileType.File and i.path not in own:
                    fs.delete_file(i.path)

    def abort(self, messages):
        fs, root = open_fs(self.path)
        for n in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path); df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    bounded_batches(spark)


def archive_pages(pages: DataFrame, out: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a record per page under `out` and returns them as read back (columns of SCHEMA).

    Of records with equal payloads of at least `least` bytes, that with the largest id is a response and others revisit it.
    Equal: SHA-1, SHA-256 and length agree. Only digests that occur more than once are joined, from a
    table of a row per digest. Null body: empty payload. Null ids never are the response of a group unless all are null; then
    all are responses. Rows that share the largest id are all responses. An empty table: no records. Extra columns are not read.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("pid"), F.col(url_col).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("d1", F.sha1("payload")).withColumn("d2", F.sha2("payload", 256))
    again = rows.filter(F.col("n") >= least).groupBy("d1", "d2", "n").agg(F.count("*").alias("many"), F.max("pid").alias("last")).filter("many > 1 AND last IS NOT NULL")
    again = stored(again.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("n").alias("an"), "last"), "copies")
    met = rows.join(again, (F.col("d1") == F.col("a1")) & (F.col("d2") == F.col("a2")) & (F.col("n") == F.col("an")), "left")
    revisit = F.col("last").isNotNull() & ~F.col("pid").eqNullSafe(F.col("last"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    records = met.select(
        name(F.col("pid")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, name(F.col("last"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "d1").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").option("path", out).save()
    return spark.read.format("warc").option("path", out).load()


def op5_warc(spark, sf_dir: str) -> DataFrame:
    got = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    whole = F.col("record_type") == "response"
    return got.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
