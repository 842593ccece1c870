"""Token ids in binary shards: documents compressed one by one with a shared zstandard dictionary.

A shard is  MAGIC | dictionary's SHA-256 | frames | index | number of documents, index offset | MAGIC.
The index has doc_id, frame offset, frame length, tokens and a null flag per document, so that one short document can
be read alone. Ids are little-endian unsigned integers of 16 bits (or 32, where the vocabulary needs it).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut_text, fresh_path, open_fs, text_slices, trim, utf8_column, worker_cache, write_whole

MAGIC = b"LSTOK001"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("null", "<u4"), ("tokens", "<u8")])
#: Distinct pieces of words that a worker remembers (about 200 bytes each); beyond it the half that was met last goes: the commonest are met first.
PIECES = 300_000
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_BARE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How byte-level models show a byte: printable ones as themselves, the others from 256 on.
_SHOWN = dict(zip([b for b in range(256) if b not in _BARE], range(256, 512)))
#: What a document gives to the dictionary's training.
PARTS, PART = 4, 8 << 10
#: Bytes of text in a shard, about.
SHARD_BYTES = 128 << 20
#: Bytes of text encoded at once; a longer text is cut at white space.
SLICE = 2 << 20


class _Memo(dict):
    """Looks a piece up, or learns it."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class ChunkEncoder:
    """Encodes with the tokenizers library, once for each distinct chunk between ASCII white space in a slice of text.

    That is exact for tokenizers that drop white space and never look across it. Arrow finds a slice's distinct
    chunks; chunks of plain Latin characters are cut further, at the vocabulary's own pre-token borders, and only a piece that this
    worker has not met is given to the model. A slice's ids are then laid out by the chunks' places in it.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype(self.code)
        self.pieces, self.most = _Memo(self._learn), pieces
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # white space is dropped and case folded by some vocabularies only
        self.lower = self._same("That's ÉTÉ 42nd", "that's été 42nd")
        # pre-token borders are known for one vocabulary; others are encoded a chunk at a time
        self.cut = self.lower and self._piecewise()

    def _same(self, x: str, y: str) -> bool:
        return self.tokenizer.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(y, add_special_tokens=False).ids

    def _piecewise(self) -> bool:
        probe = "That's 42nd, (été) O'Neill's!! x_y 'tis ...'s ÀB"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        try:
            return b"".join(self._pieces(w.lower()) for w in probe.split()) == self.pack(whole)
        except Exception:  # noqa: BLE001  a model without single-piece calls
            return False

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _pieces(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.pieces[chunk]
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk)))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        out = list(map(self.pieces.get, chunks))  # most chunks are bare words
        rest = []
        for i in [i for i, v in enumerate(out) if v is None]:
            s, out[i] = chunks[i], b""
            if self.cut and _PLAIN.fullmatch(s) and not ("<|" in s and any(x in s for x in self.specials)):
                out[i] = self._pieces(s.lower())
            elif s:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = self.pack(e.ids)
        if len(self.pieces) > self.most:
            for k in list(self.pieces)[len(self.pieces) // 2 :]:
                del self.pieces[k]
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end, and where each begins and ends in them."""
        if self.lower:  # fewer distinct chunks; what may hold a special token, which has a case, stays
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        named = words.flatten().dictionary_encode()
        distinct = named.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py()
        packed = self._chunks(joined.split(" ") if len(distinct) else [])
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(packed), self.dtype)
        at = named.indices.to_numpy(zero_copy_only=False)
        many = sizes[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], many)
        return ids[place], ends[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        for i, j in text_slices([len(t) for t in texts], SLICE):
            if len(texts[i]) > SLICE:
                out.append(b"".join(self._slice(pa.array([p], pa.binary()).cast(pa.string()))[0].tobytes() for p in cut_text(texts[i], SLICE)))
                continue
            ids, ends = self._slice(pa.array(texts[i:j], pa.binary()).cast(pa.string()))
            raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
            out += [raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return out


def encoder(path: str) -> ChunkEncoder:
    return worker_cache(f"tokens {path}", lambda: ChunkEncoder(path))


def _parts(ids: bytes) -> Iterator[bytes]:
    """Up to PARTS stretches of PART bytes, spread evenly over a document's ids."""
    last = max(len(ids) - PART, 0) // 4 * 4
    for at in sorted({last * k // (PARTS - 1) // 4 * 4 for k in range(PARTS)}):
        yield ids[at : at + PART]


def _dictionary(docs: DataFrame, tokenizer: str, sample: int, size: int, total: int) -> bytes:
    """A zstandard dictionary trained on the id arrays of about `sample` documents, chosen by hash.

    A long document gives PARTS stretches from its beginning to its end, so the driver takes 2 * sample * PARTS * PART bytes at most (64 MB).
    Where training fails for lack of samples, the ids themselves are the dictionary; without any id it is empty.
    """
    share = min(1.0, sample / max(total, 1))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(_parts(x)) for x in enc.encode(utf8_column(b, "text"))], pa.list_(pa.binary()))], ["ids"])

    got = [bytes(x) for r in chosen.select("text").mapInArrow(ids, "ids array<binary>").limit(2 * sample).collect() for x in r[0] if x]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, got)) // 10)), got, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(got)[-size:]


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int,
    shards: int | None = None,
    dict_sample: int = 1000,
    dict_bytes: int = 64 << 10,
    level: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes every document's ids, with end_id after them, in ascending doc_id order to shards under `out`.

    Returns the manifest (shard, path, docs, tokens), one row per shard, stored in `out` too. Documents
    are range-partitioned by id into shards of about SHARD_BYTES of text (`shards` fixes their number), so shard order is id order; ties are ordered by the text's hash.
    Null ids come first; a null or empty text has the end id only. An empty table gives an empty manifest.
    A repeated task writes the same bytes under a fresh name and renames, so a lost executor leaves no half file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, volume = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    trained = _dictionary(rows, tokenizer, dict_sample, dict_bytes, total)
    digest = hashlib.sha256(trained).digest()
    write_whole(f"{out}/{digest.hex()}.dict", iter([trained]))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        end, width = enc.pack([end_id]), enc.dtype.itemsize
        index: list[tuple] = []

        def parts() -> Iterator[bytes]:
            yield MAGIC + digest
            at = len(MAGIC) + len(digest)
            for b in batches:
                for k, packed in zip(b.column("doc_id").to_pylist(), enc.encode(utf8_column(b, "text")), strict=True):
                    frame = packer.compress(packed + end)
                    index.append((0 if k is None else k, at, len(frame), k is None, len(packed) // width + 1))
                    at += len(frame)
                    yield frame
            yield np.array(index, INDEX).tobytes() + struct.pack("<QQ", len(index), at) + MAGIC

        path = f"{out}/shard-{shard:06d}.tok"
        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        write_whole(path, parts())
        tokens = sum(x[4] for x in index)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([len(index)]), pa.array([tokens])], ["shard", "path", "docs", "tokens"])

    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    manifest = ordered.mapInArrow(write, "shard long, path string, docs long, tokens long")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{out}/manifest")


def _chain(first, rest):
    yield first
    yield from rest


def read_index(uri: str) -> tuple[np.ndarray, bytes]:
    """A shard's index and the SHA-256 of its dictionary."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        head = f.read_at(len(MAGIC) + 32, 0)
        n, at = struct.unpack("<QQ", (tail := f.read_at(16 + len(MAGIC), size - 16 - len(MAGIC)))[:16])
        if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        return np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX), head[len(MAGIC) :]


def load_dictionary(uri: str, digest: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary beside a shard, checked against the hash that the shard keeps."""
    fs, path = open_fs(f"{uri.rpartition('/')[0]}/{digest.hex()}.dict")
    with fs.open_input_file(path) as f:
        data = f.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary's hash differs from the shard's")
    return zstandard.ZstdCompressionDict(data) if data else None


def read_document(uri: str, row: np.void, dictionary, dtype: str = "<u2") -> np.ndarray:
    """One document's ids: a single read of its frame."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        frame = f.read_at(int(row["length"]), int(row["offset"]))
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame), dtype)


def read_tokens(manifest: DataFrame, with_ids: bool = True, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids array<int>, read from the shards.

    start counts the ids of all documents before; the shards' sums, one number a shard, are added up on the driver.
    """
    spark = manifest.sparkSession
    shards, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        shards.append((r["path"], base))
        base += r["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                index, digest = read_index(uri)
                unpack = zstandard.ZstdDecompressor(dict_data=load_dictionary(uri, digest))
                fs, path = open_fs(uri)
                starts = before + np.concatenate([[0], np.cumsum(index["tokens"].astype("<i8"))])[:-1]
                with fs.open_input_stream(path) as f:
                    f.read(len(MAGIC) + 32)
                    for i in range(0, len(index), 500):
                        part, crc, ids = index[i : i + 500], [], []
                        for row in part:
                            a = np.frombuffer(unpack.decompress(f.read(int(row["length"]))), dtype)
                            if len(a) != row["tokens"]:
                                raise ValueError(f"{uri}: a frame has {len(a)} ids, its index {row['tokens']}")
                            crc.append(zlib.crc32(a.astype("<u4").tobytes()))
                            if with_ids:
                                ids.append(a.astype("<i4"))
                        cols = [pa.array(part["doc_id"], mask=part["null"].astype(bool)), pa.array(starts[i : i + 500]), pa.array(part["tokens"].astype("<i8")), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    if not shards:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame(shards, "path string, base long").repartition(len(shards))
    return plan.mapInArrow(read, schema)


def op8_token_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, fresh_path(spark, "tokens"), tokenizer, end_id=2)
    return read_tokens(manifest, with_ids=False)
