"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every window of `length` bytes is given to the K-gram in it with the smallest hash: equal windows have the same one, so equal
windows meet under one key whatever surrounds them. Successive windows with the same K-gram are a stretch of
text. Stretches are counted by key and content first, so copies cost a row each; only keys under which different
stretches meet go on to the shards. A shard holds whole keys: its suffix array is built by Larsson-Sadakane refinement and
common prefixes follow by Kasai's rule. A key with very many different stretches is dealt to several shards; what they
share is found by binary search of each one's windows, in order of their 128-bit hashes, among those of all, range by range.

Two stretches are taken for equal if they agree in key and content, 64 bits each; only stretches under one key are compared so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, stored, utf8_column

GRAM = 64
#: Bytes of a text that are winnowed at once.
BLOCK = 1 << 19
#: Stretches in a shard, about: one has under 2 * length bytes, so this bounds the suffix array's memory.
SHARD = 3000
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed hash of the K-gram at each position."""
    up, down = _powers(BLOCK + 4096)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def stretches(b: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, key): runs of window starts that share the leftmost smallest K-gram, for one text of at most BLOCK windows."""
    h = gram_hashes(b)
    w = length - GRAM + 1
    n = len(b) - length + 1
    # the hash's upper bits, then the position: the smallest is leftmost among equals
    v = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(v) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max)
    grid[: len(v)] = v
    grid = grid.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.append(cut - 1, n - 1)
    key = h[(least[first] & np.uint64((1 << 20) - 1)).astype(np.int64)].view(np.int64)
    yield from zip(first.tolist(), last.tolist(), key.tolist(), strict=True)


def text_stretches(text: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, key, content hash) of a whole text; blocks overlap, so no window is lost at their borders."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - length + 1, BLOCK):
        for s, e, key in stretches(raw[at : at + BLOCK + length - 1], length):
            yield at + s, at + e, key, np.uint64(xxhash.xxh3_64_intdigest(text[at + s : at + e + length])).view(np.int64).item()


def suffix_array(b: np.ndarray) -> np.ndarray:
    """All suffixes in order: Larsson-Sadakane refinement.

    A suffix's rank is the first place of its group. A round sorts only groups that are not single yet, by the rank of
    the suffix h further on, and doubles h. It ends when every group is single: Kasai's rule needs the whole order.
    """
    n = len(b)
    padded = np.concatenate([b.astype(np.int64) + 1, np.zeros(6, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):  # 9 bits each
        key = (key << 9) | padded[j : j + n]
    order = np.argsort(key).astype(np.int32)
    sorted_ = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    at, h = np.flatnonzero(~(new & np.append(new[1:], True))), 7
    while len(at):
        sub = order[at]
        pair = rank[sub].astype(np.int64) * (n + 2) + rank[np.minimum(sub + h, n)] + 1
        o = np.argsort(pair)
        sub, pair = sub[o], pair[o]
        order[at] = sub
        differ = np.ones(len(at), bool)
        differ[1:] = pair[1:] != pair[:-1]
        rank[sub] = np.maximum.accumulate(np.where(differ, at, 0))
        at = at[~(differ & np.append(differ[1:], True))]
        h *= 2
    return order


def common_prefixes(b: np.ndarray, order: np.ndarray, upto: int, lanes: int = 32768) -> np.ndarray:
    """Length, at most `upto`, of what each suffix in the array shares with the one before it (0 for the first).

    Kasai's rule: in text order the length falls by at most one a step. Lanes of text are walked side by side, and
    eight bytes are compared at once; the lowest bit that differs tells how many of them agree.
    """
    n = len(b)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    long = np.zeros(n, np.int64)
    padded = np.concatenate([b, np.zeros(upto + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()
    span = -(-n // max(1, min(lanes, n)))
    lane = np.arange(0, n, span)
    have = np.zeros(len(lane), np.int64)
    for t in range(span):
        i = lane + t
        ok = i < n
        prior = before[np.minimum(i, n - 1)]
        have = np.where(ok & (prior >= 0), np.maximum(have - 1, 0), 0)
        go = np.flatnonzero(ok & (prior >= 0) & (have < upto))
        while len(go):
            x, y = i[go] + have[go], prior[go] + have[go]
            apart = words[np.minimum(x, n + upto)] ^ words[np.minimum(y, n + upto)]
            agree = np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3)
            agree = np.minimum(agree, n - np.maximum(x, y))  # not beyond the text's end
            have[go] += agree
            go = go[(agree == 8) & (have[go] < upto)]
        np.minimum(have, upto, out=have)
        long[i[ok]] = have[ok]
    return long[order]


class Shard:
    """Stretches laid end to end, and the starts of whole windows in them."""

    def __init__(self, rows: list[dict], length: int):
        self.rows, self.length = rows, length
        sizes = np.array([len(r["body"]) for r in rows])
        self.b = np.frombuffer(b"".join(r["body"] for r in rows), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.whole = np.arange(len(self.b)) + length <= (self.begin + sizes)[self.owner]

    def repeated(self) -> np.ndarray:
        """Starts of windows that occur at two starts at least."""
        self.order = suffix_array(self.b)
        same = common_prefixes(self.b, self.order, self.length) >= self.length
        group = np.cumsum(~same)
        whole = self.whole[self.order]
        many = np.bincount(group[whole], minlength=group[-1] + 1)
        return np.sort(self.order[whole & (many[group] > 1)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of whole windows, and the windows' 128-bit hashes."""
        starts, view = np.flatnonzero(self.whole), memoryview(self.b)
        return starts, np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s : s + self.length]) for s in starts.tolist()]), "S16")

    def runs(self, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(key, content, first, last): runs of starts, counted from their stretch's beginning."""
        if not len(starts):
            return []
        own = self.owner[starts]
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(own) != 0)) + 1
        out = []
        for x, y in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(starts)).tolist(), strict=True):
            r, o = self.rows[own[x]], self.begin[own[x]]
            out.append((r["key"], r["content"], int(starts[x] - o), int(starts[y - 1] - o)))
        return out


_RUNS = ["key", "content", "u", "v"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _RUNS)


def repeated_runs(bodies: DataFrame, length: int) -> DataFrame:
    """(key, content, u, v): windows repeated among the different stretches (key, content, body) of each key."""
    total = bodies.count()
    buckets = max(1, -(-total // (SHARD // 2)))
    placed = bodies.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    full = placed.groupBy(F.col("bucket").alias("fb")).agg(F.count("*").alias("n")).filter(f"n > {SHARD}").select("fb", F.ceil(F.col("n") / SHARD).alias("subs"))
    placed = placed.join(stored(full, "full"), F.col("bucket") == F.col("fb"), "left")
    placed = placed.withColumn("sub", F.when(F.col("subs").isNull(), 0).otherwise(F.pmod(F.xxhash64("content"), F.col("subs"))))
    shards = placed.groupBy("bucket", "sub").agg(F.collect_list(F.struct("key", "content", "body")).alias("x"), F.max("subs").alias("subs"))
    # a task has a few shards, however small a file they stand in
    shards = stored(shards, "shards").repartition(max(1, 2 * total // SHARD), "bucket", "sub")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Shard(b.column("x")[i].as_py(), length)
                if rows := s.runs(s.repeated()):
                    yield _batch(rows)

    schema = "key long, content long, u long, v long"
    dealt = shards.filter("subs IS NOT NULL")
    return shards.select("x").mapInArrow(own, schema).union(_across(dealt, length).mapInArrow(_met_runs(length), schema))


def _across(dealt: DataFrame, length: int) -> DataFrame:
    """(x, hashes): each shard of a dealt bucket with the hashes of those of its windows that another of its shards has too.

    A shard's different windows are put in order of their hash and cut into as many ranges as the bucket has shards. Of a range, every shard's part
    is searched for in all parts laid in order; so the work follows the number of windows, and no two shards meet whole.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                bucket, sub, subs = (b.column(c)[i].as_py() for c in ("bucket", "sub", "subs"))
                h = np.unique(Shard(b.column("x")[i].as_py(), length).digests()[1])
                upper = np.frombuffer(h.tobytes(), ">u4")[::4].astype(np.uint64)
                edges = np.searchsorted(upper * np.uint64(subs) >> np.uint64(32), np.arange(subs + 1))
                parts = [(bucket, sub, r, h[x:y].tobytes()) for r, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts, strict=True)], ["bucket", "sub", "range", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                bucket, parts = b.column("bucket")[i].as_py(), b.column("parts")[i].as_py()
                own = [np.frombuffer(p["hashes"], "S16") for p in parts]
                every = np.sort(np.concatenate(own))
                found = []
                for p, h in zip(parts, own, strict=True):
                    many = np.searchsorted(every, h, "right") - np.searchsorted(every, h, "left")
                    if (many > 1).any():
                        found.append((bucket, p["sub"], h[many > 1].tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["b2", "s2", "hashes"])

    ranges = dealt.mapInArrow(cut, "bucket long, sub long, range long, hashes binary").groupBy("bucket", "range").agg(F.collect_list(F.struct("sub", "hashes")).alias("parts"))
    met = ranges.select("bucket", "parts").mapInArrow(meet, "b2 long, s2 long, hashes binary").groupBy("b2", "s2").agg(F.collect_list("hashes").alias("hashes"))
    return dealt.join(met, (F.col("bucket") == F.col("b2")) & (F.col("sub") == F.col("s2"))).select("x", "hashes")


def _met_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s, wanted = Shard(b.column("x")[i].as_py(), length), np.sort(np.frombuffer(b"".join(b.column("hashes")[i].as_py()), "S16"))
                starts, h = s.digests()
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                if rows := s.runs(starts[wanted[at] == h]):
                    yield _batch(rows)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans array<struct<s,e>> (bytes), kept binary, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else in the input, in the same text or another.
    Kept bytes may end within a character, so they are binary; null where nothing is removed (the text is whole).
    Null text: empty. Texts shorter than `length`: nothing goes. Repeated rows repeat each other. Null ids
    are kept. No other column is read. Texts move twice at most: all once, those with repeats once more.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 8 << 20)
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ths = b.column("doc_id").to_pylist(), b.column("th").to_pylist()
            rows = []
            for d, th, t in zip(ids, ths, utf8_column(b, "text"), strict=True):
                rows += [(d, th, *x) for x in text_stretches(t, length)]
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["doc_id", "th", "s", "e", "key", "content"]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("th", F.xxhash64("text"))
    parts = stored(base.mapInArrow(cut, ", ".join(f"{n} long" for n in names)), "stretches")
    groups = parts.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"), (F.min("content") == F.max("content")).alias("alike")).filter("n > 1").drop("n")
    marked = stored(parts.join(stored(groups, "keys"), F.col("key") == F.col("k")).drop("k"), "marked")
    # under a key with different stretches: how often each occurs, and where one is
    kinds = marked.filter("NOT alike").groupBy("key", "content").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "th", "s", "e")).alias("at"))
    kinds = stored(kinds, "kinds")
    wanted = kinds.select(F.col("at.doc_id").alias("d"), F.col("at.th").alias("h"), F.struct("at.s", "at.e", "key", "content").alias("w"))
    touched = marked.select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct().withColumn("w", F.lit(None).cast(wanted.schema["w"].dataType))
    by_doc = wanted.union(touched).groupBy("d", "h").agg(F.collect_list("w").alias("w"))  # nulls are not collected
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    laid = base.join(by_doc, same, "left").select(
        "doc_id", "th", "w", F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(F.col("w").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.when(F.col("w").isNotNull(), F.col("text")).alias("text"),
    )
    laid = stored(laid, "laid")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ws, t in zip(b.column("w").to_pylist(), utf8_column(b, "text"), strict=True):
                rows += [(w["key"], w["content"], t[w["s"] : w["e"] + length]) for w in ws]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "content", "body"])

    taken = laid.filter("size(w) > 0").mapInArrow(bodies, "key long, content long, body binary").groupBy("key", "content").agg(F.first("body").alias("body"))
    runs = stored(repeated_runs(stored(taken, "bodies"), length), "runs")
    runs = runs.join(kinds.filter("many = 1").select(F.col("key").alias("k1"), F.col("content").alias("c1")), (F.col("key") == F.col("k1")) & (F.col("content") == F.col("c1"))).select(*_RUNS)
    whole = kinds.filter("many > 1").select("key", "content", F.lit(0).cast("long").alias("u"), F.lit(None).cast("long").alias("v"))
    told = stored(runs.union(whole).toDF("k2", "c2", "u", "v"), "told")
    differing = marked.filter("NOT alike").join(told, (F.col("key") == F.col("k2")) & (F.col("content") == F.col("c2")))
    spans = differing.select("doc_id", "th", (F.col("s") + F.col("u")).alias("x"), F.coalesce(F.col("s") + F.col("v"), F.col("e")).alias("y"))
    spans = spans.union(marked.filter("alike").select("doc_id", "th", F.col("s").alias("x"), F.col("e").alias("y")))
    spans = spans.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_list(F.struct("x", "y")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, found, sha = b.column("text")[i].as_py(), b.column("found")[i].as_py(), b.column("sha")[i].as_py()
                gone, kept = [], None
                for x, y in sorted((f["x"], f["y"] + length) for f in found or []):
                    if gone and x <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], y)
                    else:
                        gone.append([x, y])
                if t is not None:
                    raw = t.encode()
                    if gone:
                        edges = [0, *(v for g in gone for v in g), len(raw)]
                        kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    sha = hashlib.sha256(raw if kept is None else kept).hexdigest()
                cols = [b.column("doc_id").slice(i, 1), b.column("n_bytes").slice(i, 1), pa.array([sum(y - x for x, y in gone)]), pa.array([len(gone)], pa.int64())]
                cols += [pa.array([[{"s": x, "e": y} for x, y in gone]], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([kept], pa.binary()), pa.array([sha])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<s:long,e:long>>, kept binary, kept_sha256 string"
    edited = laid.filter("w IS NOT NULL").join(spans, same, "left").select("doc_id", "n_bytes", "sha", "text", "found").mapInArrow(remove, schema)
    none = F.array().cast("array<struct<s:long,e:long>>")
    plain = laid.filter("w IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), none.alias("spans"), F.lit(None).cast("binary").alias("kept"), F.col("sha").alias("kept_sha256"))
    return edited.union(plain)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans", "kept")
