"""Helpers shared by the operators: tables in the shared folder, bounded Arrow batches, files."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to numpy at once: bounds a Python worker's memory whatever a batch holds.
CHUNK_BYTES = 1 << 20
_FOLDERS: dict[int, str] = {}
_CACHE: dict[str, object] = {}
_GAP = re.compile(rb"[ \t-\r]")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all executors share.

    Where the setting is unset and all runs in one process, as in tests, a temporary folder is set for the session.
    The folder is removed when the driver's Python ends.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if sc.master.partition("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="loomseg-")
            spark.conf.set("spark.checkpoint.dir", base)
        _FOLDERS[key] = f"{base.rstrip('/')}/loomseg-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _FOLDERS[key])
    return _FOLDERS[key]


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        drop_folder(spark, folder)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what stored() wrote, once nothing will read it again."""
    for t in tables:
        drop_folder(t.sparkSession, t._folder)


def bounded_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Arrow batches to Python hold at most so many bytes (unless one row is larger)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > most:
        spark.conf.set(key, str(most))


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def worker_cache(name: str, make):
    """A Python worker's cache for one operator. Workers serve one stage after another: a new operator's turn drops the last one's cache."""
    if name not in _CACHE:
        _CACHE.clear()
        gc.collect()
        trim()
        _CACHE[name] = make()
    return _CACHE[name]


def held_out(doc_id: Column) -> Column:
    """True for rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_slices(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most `most` bytes together; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def cut_text(text: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut at ASCII white space: a word that is longer stays whole."""
    at = 0
    while len(text) - at > most:
        found = _GAP.search(text, at + most)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null is empty."""
    return [b"" if v is None else v for v in batch.column(name).cast(pa.binary()).to_pylist()]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def write_whole(uri: str, parts: Iterator[bytes]) -> None:
    """Writes a file under a name of its own and then renames it, so a repeated task leaves one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(temp) as f:
        for p in parts:
            f.write(p)
    fs.move(temp, path)
