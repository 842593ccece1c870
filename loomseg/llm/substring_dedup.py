"""Removal of word sequences that an earlier document has too, by suffix automata of reference shards.

A window is `length` consecutive words. It is given to the gram of GRAM words in it with the smallest hash, its anchor: equal windows have
the same one. Anchors that occur in one document only are dropped; successive windows of one of the others are a stretch of the document.
The different stretches, each with the smallest document that has it, are the reference. It is dealt by anchor into
shards of bounded size. A shard is broadcast to the tasks that stream its stretches, and each of them builds its suffix automaton, whose
states know the smallest document of their strings: matching statistics then tell of each window whether a smaller document
has it. What travels is the shard's text, as its automaton is ten times as large. Hashes only say what meets: equality is decided by the automata, word by word.

Frequent lines in many surroundings would put very many different stretches under one anchor. The stretches of such an anchor are cut
under anchors of longer grams, and where that does not do into single windows, which meet under their own hash, so a shard stays small. A shard with very many stretches to stream is broadcast to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import bounded_batches, cut_text, release, stored, trim

GRAM = 16
#: Words that are winnowed at once, and windows of a stretch at most.
SEGMENT, RUN = 1 << 17, 256
#: Words of a shard's reference, about; what stands under an anchor with more than FULL is cut finer, under grams of these shares of a window.
SHARD_WORDS, FULL = 40_000, 100_000
FINER = (0.8, 0.92, 1.0)
#: At most so many anchors or shards count as hot: what holds a larger share of the rows than one in HOT.
HOT = 4096
SALTS = 64
_BASE = 0xD1342543DE82EF95
_NONE = np.iinfo(np.int64).max
_SPANS = "doc_id long, th long, a long, b long"


def anchors(h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of each window of `length` words (given by hash), the smallest hash of a gram in it."""
    n = len(h) - length + 1
    up, down = words.powers(SEGMENT + 2 * length + 2, _BASE)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    g = words.mixed((total[gram:] - total[:-gram]) * down[: len(h) - gram + 1])
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        g, have = np.minimum(g[:-have], g[have:]), 2 * have
    return np.minimum(g[:n], g[span - have : span - have + n])


def runs(column: pa.Array, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor, first window, windows, first byte, byte after the last) of each run of windows with one anchor, for a column of texts.

    Windows are counted within their text. Long texts come in segments that overlap by length - 1 words.
    """
    data, offsets = words.text_bytes(column)
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    before = 0  # words ahead of those that are held
    first_word = np.zeros(len(offsets) - 1, np.int64)
    counted = -1
    for a, b, start, end, h in words.words(data, offsets):
        doc = np.searchsorted(offsets, start, "right") - 1
        new, at = np.unique(doc, return_index=True)
        fresh = new > counted
        first_word[new[fresh]] = before + len(held[0]) + at[fresh]
        counted = max(counted, int(new[-1]) if len(new) else -1)
        held = [np.concatenate(x) for x in zip(held, (start, end, h), strict=True)]
        while len(held[0]) >= length and (len(held[0]) > SEGMENT or b == len(data)):
            part = [x[: SEGMENT + length - 1] for x in held]
            yield from _runs(*part, offsets, first_word, before, length, gram)
            n = len(part[0]) - length + 1
            held, before = [x[n:] for x in held], before + n
    del data


def _runs(start, end, h, offsets, first_word, before, length, gram):
    n = len(start) - length + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    key, d = anchors(h, length, gram).view(np.int64), doc[:n]
    whole = d == doc[length - 1 :]
    place = np.arange(n) + before - first_word[d]
    cut = np.ones(n + 1, bool)
    cut[1:n] = (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (place[1:] % RUN == 0) | (whole[1:] != whole[:-1])
    edge = np.flatnonzero(cut)
    at, size = edge[:-1], np.diff(edge)
    ok = whole[at]
    at, size = at[ok], size[ok]
    if len(at):
        yield d[at], key[at], place[at], size, start[at], end[at + size + length - 2]


_TEXT = ["doc_id", "th", "tc"]


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, th, tc, anchor: the different anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in _TEXT]
            for doc, key, *_ in runs(batch.column("text"), length):
                pairs = np.unique(np.stack([doc, key], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([*[pa.array(c[pairs[:, 0]]) for c in own], pa.array(pairs[:, 1])], [*_TEXT, "anchor"])
        trim()

    return docs.select(*_TEXT, "text").mapInArrow(run, "doc_id long, th long, tc long, anchor long")


def _shared(found: DataFrame) -> DataFrame:
    """The rows of found whose anchor two documents have. Hot anchors are few by their definition and are broadcast; the others are joined."""
    groups = stored(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "n"), "anchors")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("n") > max(1000, total // HOT)).select("anchor"))
    rest = found.join(hot, "anchor", "left_anti").join(groups.select("anchor"), "anchor", "left_semi")
    return found.join(hot, "anchor", "left_semi").union(rest)


def stretches(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, doc_id, th, first, body: the stretches of documents under wanted anchors (doc_id, keep: array). body: its words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, keep = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy(), batch.column("keep")
            offsets, values = keep.offsets.to_numpy(), keep.values.to_numpy()
            sets = [np.sort(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            raw = memoryview(words.text_bytes(batch.column("text"))[0])
            for doc, key, first, _, a, b in runs(batch.column("text"), length):
                ok = np.zeros(len(doc), bool)
                for x, y in zip(*_groups(doc), strict=True):
                    own = sets[doc[x]]
                    ok[x:y] = own[np.minimum(np.searchsorted(own, key[x:y]), len(own) - 1)] == key[x:y] if len(own) else False
                at = np.flatnonzero(ok)
                for lo in range(0, len(at), 2048):
                    i = at[lo : lo + 2048]
                    body = [b" ".join(bytes(raw[x:y]).split()) for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(ids[doc[i]]), pa.array(ths[doc[i]]), pa.array(first[i]), pa.array(body, pa.binary())], _UNIT)
            del raw, batch
        trim()

    return docs.join(wanted, "doc_id").select("doc_id", "th", "keep", "text").mapInArrow(run, _UNITS)


_UNIT = ["key", "doc_id", "th", "first", "body"]
_UNITS = "key long, doc_id long, th long, first long, body binary"


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
    return edge[:-1], edge[1:]


def finer(units: DataFrame, length: int, gram: int) -> DataFrame:
    """Each stretch as stretches under anchors of longer grams; of `length` words: each window under its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body")
            raw = memoryview(words.text_bytes(bodies)[0])
            ids, ths, firsts = (batch.column(c).to_numpy() for c in ("doc_id", "th", "first"))
            for of, key, place, _, a, b in runs(bodies, length, gram):
                for lo in range(0, len(of), 2048):
                    i = slice(lo, lo + 2048)
                    body = [bytes(raw[x:y]) for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(ids[of[i]]), pa.array(ths[of[i]]), pa.array(firsts[of[i]] + place[i]), pa.array(body, pa.binary())], _UNIT)
            del raw, batch
        trim()

    return units.select(*_UNIT).mapInArrow(run, _UNITS)


def _split_full(units: DataFrame, full: DataFrame, length: int, gram: int) -> DataFrame:
    """units, those under a full key under finer ones. Full keys are few, so they are laid out under every salt."""
    salted = units.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int"))
    spread = full.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(spread, ["key", "salt"], "left_anti").select(*_UNIT).union(finer(salted.join(spread, ["key", "salt"], "left_semi"), length, gram))


class Automaton:
    """Suffix automaton of word sequences, each with a number; of a window of `length` words it tells the smallest number of a sequence that holds it."""

    def __init__(self, bodies: list[bytes], numbers: list[int], length: int):
        self.length = length
        self.ids: dict[bytes, int] = {}
        moves: list[dict[int, int]] = [{}]
        link, size, low = [-1], [0], [_NONE]

        def copied(p: int, q: int, c: int) -> int:
            """A state for the strings of q that p's are prefixes of."""
            clone = len(size)
            moves.append(dict(moves[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            low.append(_NONE)
            while p >= 0 and moves[p].get(c) == q:
                moves[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        for body, number in zip(bodies, numbers, strict=True):
            last = 0
            for word in body.split(b" "):
                c = self.ids.setdefault(word, len(self.ids))
                p, q = last, moves[last].get(c)
                if q is None:
                    last = len(size)
                    moves.append({})
                    size.append(size[p] + 1)
                    low.append(_NONE)
                    link.append(0)
                    while p >= 0 and c not in moves[p]:
                        moves[p][c] = last
                        p = link[p]
                    if p >= 0:
                        q = moves[p][c]
                        link[last] = q if size[q] == size[p] + 1 else copied(p, q, c)
                else:
                    last = q if size[q] == size[p] + 1 else copied(p, q, c)
                if number < low[last]:
                    low[last] = number
        order = np.argsort(np.array(size), kind="stable").tolist()
        for v in order[:0:-1]:
            if low[v] < low[link[v]]:
                low[link[v]] = low[v]
        # the strings of `length` words that end where a state's do belong to the ancestor whose own link is shorter
        top = list(range(len(size)))
        for v in order:
            if size[v] >= length and size[link[v]] >= length:
                top[v] = top[link[v]]
        self.moves, self.link, self.size, self.low = moves, link, size, [low[t] for t in top]

    def smallest(self, body: bytes) -> np.ndarray:
        """Of each window of a text, the smallest number of a sequence that holds it: matching statistics of at least `length`."""
        moves, link, size, low, ids, least = self.moves, self.link, self.size, self.low, self.ids, self.length
        v = have = 0
        out = []
        for word in body.split(b" "):
            c = ids.get(word, -1)
            if c < 0:
                v = have = 0
                out.append(_NONE)
                continue
            q = moves[v].get(c)
            while q is None and v:
                v = link[v]
                have = size[v]
                q = moves[v].get(c)
            if q is not None:
                v, have = q, have + 1
            out.append(low[v] if have >= least else _NONE)
        return np.array(out[least - 1 :], np.int64)


def matched(units: DataFrame, reference: DataFrame, length: int) -> DataFrame:
    """doc_id, th, a, b: runs of words that a smaller document has too. units: shard, doc_id, th, first, body; reference: shard, body, lo.

    A shard's reference comes ahead of the stretches of each of its parts; the task builds the automaton of it and streams what follows.
    """
    counts = stored(units.groupBy("shard").agg(F.count("*").alias("n")), "loads")
    total = counts.agg(F.sum("n")).first()[0] or 0
    fair = max(10_000, total // HOT)
    hot = counts.where(F.col("n") > fair).select("shard", F.ceil(F.col("n") / fair).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "first"), F.col("parts")), F.lit(0)).cast("int")
    stream = units.join(F.broadcast(hot), "shard", "left").select("shard", part.alias("part"), F.lit(1).alias("kind"), "doc_id", "th", "first", "body")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    none = F.lit(None).cast("long")
    sent = reference.join(F.broadcast(hot), "shard", "left").select("shard", parts.alias("part"), F.lit(0).alias("kind"), F.col("lo").alias("doc_id"), none.alias("th"), none.alias("first"), "body")
    # by range: shards are few for so many tasks, and hashes would put several into one
    dealt = sent.union(stream).repartitionByRange("shard", "part").sortWithinPartitions("shard", "part", "kind", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, automaton, last, smallest = None, [], None, None, None
        for batch in batches:
            found = []
            for shard, part, kind, doc_id, th, first, body in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if (shard, part) != own:
                    own, held, automaton, last = (shard, part), [], None, None
                if kind == 0:
                    held.append((body, doc_id))
                    continue
                if automaton is None:
                    automaton, held = Automaton(*zip(*held, strict=True), length), []
                if body != last:
                    last, smallest = body, automaton.smallest(body)
                hit = smallest < doc_id
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                    found += [(doc_id, th, first + a, first + b + length - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "th", "a", "b"])
        trim()

    return dealt.mapInArrow(run, _SPANS)


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, th, a, b for docs (doc_id, text, th, tc): words a to b, end exclusive, are covered by windows that smaller documents have too; b may lie beyond the end.

    Of the documents with one text, as two 64-bit hashes tell, the smallest stands for all: the others lose every window to it.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = stored(_anchored(known, length), "winnowed")
    owners = found.select(*_TEXT).distinct()
    firsts = stored(owners.groupBy("th", "tc").agg(F.min("doc_id").alias("doc_id")), "firsts")
    # rows are met on the id too, so copies of one text spread over all tasks
    copies = stored(owners.join(firsts, _TEXT, "left_anti").select("doc_id", "th", F.lit(0).cast("long").alias("a"), F.lit(1 << 62).alias("b")), "copies")
    own = stored(found.join(firsts, _TEXT, "left_semi").select("doc_id", "anchor"), "anchored")
    release(found, firsts)
    wanted = _shared(own).groupBy("doc_id").agg(F.collect_list("anchor").alias("keep"))
    units = stored(stretches(known, wanted, length), "units")
    release(own)
    n_words = F.size(F.split(F.col("body").cast("string"), " "))
    per = lambda u: stored(u.groupBy("key", "body").agg(F.min("doc_id").alias("lo")).withColumn("n", n_words), "reference")
    reference = per(units)
    for share in FINER:
        gram = round(share * length)
        full = stored(reference.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > FULL).select("key"), "full")
        if not full.isEmpty():
            cut = stored(_split_full(units, full, length, gram), "cut")
            release(units, reference)
            units, reference = cut, per(cut)
        release(full)
    shards = max(1, -(-(reference.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    spans = stored(matched(units.select(shard, "doc_id", "th", "first", "body"), reference.select(shard, "body", "lo"), length), "spans")
    release(units, reference)
    return spans.union(copies)


def remove_known(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans, spans array<struct<s,e>> (words, end exclusive), kept (its words joined by one space; null where nothing goes), kept_sha256.

    A word goes if a window of `length` words that covers it also starts in a document with a smaller id. Words are runs of bytes other
    than space and 0x09-0x0D. Null texts have no words; documents without an id lose nothing and are no reference; rows that repeat an id don't count
    against each other. No other column is read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns({"th": F.xxhash64("text"), "tc": F.xxhash64(F.lit(1), "text")})
    found = repeated_spans(base, length).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, found = batch.column("text")[i].as_py(), batch.column("found")[i].as_py()
                gone: list[list[int]] = []
                for a, b in sorted((f["a"], f["b"]) for f in found or []):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                n, sha, kept = _kept((text or "").encode(), gone)
                gone = [[a, min(b, n)] for a, b in gone]
                spans = pa.array([[{"s": a, "e": b} for a, b in gone]], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
                values = [batch.column("doc_id").slice(i, 1), pa.array([n]), pa.array([sum(b - a for a, b in gone)]), pa.array([len(gone)]), spans, pa.array([kept], pa.string()), pa.array([sha])]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_words", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])
        trim()

    schema = "doc_id long, n_words long, n_removed long, n_spans long, spans array<struct<s:long,e:long>>, kept string, kept_sha256 string"
    return base.join(found, ["doc_id", "th"], "left").select("doc_id", "text", "found").mapInArrow(run, schema)


def _kept(text: bytes, gone: list[list[int]]) -> tuple[int, str, str | None]:
    """The number of words, the digest of those outside `gone`, and those words themselves if any goes. Long texts go piece by piece."""
    digest, n, at, parts = hashlib.sha256(), 0, 0, []
    for piece in cut_text(text, 1 << 20):
        own = piece.split()
        end = n + len(own)
        while at < len(gone) and gone[at][1] <= n:
            at += 1
        keep, x, k = [], n, at
        while k < len(gone) and gone[k][0] < end:
            keep += own[x - n : max(gone[k][0], n) - n] if gone[k][0] > x else []
            x = max(x, gone[k][1])
            k += 1
        keep += own[x - n :] if x < end else []
        n = end
        if keep:
            if parts:
                digest.update(b" ")
            joined = b" ".join(keep)
            digest.update(joined)
            parts.append(joined if gone else b"")
    return n, digest.hexdigest(), b" ".join(parts).decode() if gone else None


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller id has too are removed."""
    return remove_known(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_spans", "spans", "kept")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS k FROM p),
firsts AS (SELECT k, min(doc_id) AS first FROM win WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, word, coalesce(first < doc_id, false) AS hit FROM win LEFT JOIN firsts USING (k)),
g AS (SELECT doc_id, i, word, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
r AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
