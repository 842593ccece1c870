"""Reads against the reference: its letters under each read, mismatch strings, and base qualities by alignment posteriors.

The reference comes as pieces (name, at, seq), of any length that doesn't overlap. It is cut into tiles that reach a margin beyond
their own letters, so a read meets one tile by an equi-join; a read longer than the margin meets all the tiles under it. Tiles that reads meet are laid out under
up to SALTS keys, so that the reads of one deep place are dealt to as many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reference_length
from .alignments import UNMAPPED

TILE, MARGIN, SALTS = 1024, 1024, 8
#: Tiles under a salt that the driver may hold the names of.
MET = 1 << 16


def _cut(pieces: DataFrame, tile: int, margin: int) -> DataFrame:
    """(name, t, x): what each piece has of each tile that it reaches; x: where it begins, and its letters."""
    low = F.greatest(F.floor((F.col("at") - margin - tile) / tile) + 1, F.lit(0))
    parts = pieces.filter("seq <> ''").withColumn("t", F.explode(F.sequence(low, F.floor((F.col("at") + F.length("seq") - 1) / tile))))
    first = F.greatest(F.col("t") * tile - F.col("at"), F.lit(0))
    last = F.least((F.col("t") + 1) * tile + margin - F.col("at"), F.length("seq"))
    return parts.filter(last > first).select("name", "t", F.struct((F.col("at") + first).alias("at"), F.substring("seq", (first + 1).cast("int"), (last - first).cast("int")).alias("s")).alias("x"))


def _glued(parts: DataFrame) -> DataFrame:
    return parts.groupBy("name", "t").agg(F.array_sort(F.collect_list("x")).alias("x")).select("name", "t", F.concat_ws("", "x.s").alias("letters"))


def tiles(pieces: DataFrame, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """(name, t, letters): the letters of [t * tile, (t + 1) * tile + margin) of each sequence, as far as there are any."""
    return _glued(_cut(pieces, tile, margin))


def with_reference(sam: DataFrame, pieces: DataFrame, ahead: Column | int = 0, behind: Column | int = 0, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """Adds ref_at and ref: the letters under each alignment, from `ahead` letters before it to `behind` after it, as far as the reference goes. Null where there are none.

    A first pass over the reads tells which tiles they meet, under which salts; only those are laid out. Up to MET of them are known to the driver, so that pieces
    off them are dropped where they lie; more are met by a join. The tiles are many times as large as what Spark estimates by the files, so they are not left to its choice of a broadcast.
    """
    names = sam.columns
    ahead, behind = (F.lit(x) if isinstance(x, int) else x for x in (ahead, behind))
    end = F.col("pos").cast("long") + F.coalesce(reference_length(F.col("cigar")), F.lit(0)) + behind
    reads = sam.withColumns({"ref_at": F.greatest(F.col("pos").cast("long") - ahead, F.lit(0)), "_e": end, "_salt": F.pmod(F.xxhash64("qname", "pos"), F.lit(SALTS)).cast("int")})
    reads = reads.withColumn("_t", F.floor(F.col("ref_at") / tile))
    fits = F.coalesce(F.col("_e") - F.col("_t") * tile <= tile + margin, F.lit(True))
    under = F.when(fits, F.array("_t")).otherwise(F.sequence("_t", F.floor((F.col("_e") - 1) / tile)))
    met = reads.filter("rname IS NOT NULL").select(F.col("rname").alias("_n"), F.explode(under).alias("_k"), F.col("_salt").alias("_s"), (~fits).alias("_long")).distinct()
    rows = met.limit(MET + 1).collect()
    few = len(rows) <= MET
    if few:
        met = sam.sparkSession.createDataFrame(rows, met.schema)
    spots = met.select(F.col("_n").alias("name"), F.col("_k").alias("t")).distinct()
    letters = _glued(_cut(pieces, tile, margin).join(F.broadcast(spots) if few else spots.hint("merge"), ["name", "t"], "left_semi"))
    keys = met.select("_n", "_k", "_s").distinct()
    own = letters.withColumnsRenamed({"name": "_n", "t": "_k"}).join(F.broadcast(keys) if few else keys.hint("merge"), ["_n", "_k"]).hint("merge")
    on = (F.col("rname") == F.col("_n")) & (F.col("_t") == F.col("_k")) & (F.col("_salt") == F.col("_s"))
    at = (F.col("ref_at") - F.col("_t") * tile + 1).cast("int")
    short = reads if few and not any(r["_long"] for r in rows) else reads.filter(fits)
    found = short.join(own, on, "left").withColumn("ref", F.substring("letters", at, F.greatest(F.col("_e") - F.col("ref_at"), F.lit(0)).cast("int"))).select(*names, "ref_at", "ref")
    if short is not reads:
        long = reads.filter(~fits).withColumn("_t", F.explode(F.sequence("_t", F.floor((F.col("_e") - 1) / tile)))).join(own, on, "left")
        part = F.substring("letters", F.greatest(at, F.lit(1)), F.least(F.col("_e") - F.greatest("ref_at", F.col("_t") * tile), F.least(F.lit(tile), (F.col("_t") + 1) * tile - F.col("ref_at"))).cast("int"))
        several = long.groupBy(*names, "ref_at", "_e", "_salt").agg(F.array_sort(F.collect_list(F.when(F.col("letters").isNotNull(), F.struct("_t", part.alias("s"))))).alias("_x"), F.count_distinct("_t").alias("_tiles"), F.count("*").alias("_rows"))
        whole = F.array_join(F.transform(F.array_distinct("_x"), lambda x: x["s"]), "")
        several = several.withColumn("ref", F.when(F.size("_x") > 0, whole)).withColumn("_c", F.explode(F.sequence(F.lit(1), (F.col("_rows") / F.col("_tiles")).cast("int"))))
        found = found.union(several.select(*names, "ref_at", "ref"))
    return found.withColumn("ref", F.nullif("ref", F.lit("")))


#: Letters that agree with the same one in either case.
KNOWN = frozenset("ACMGRSVTWYHKDBacmgrsvtwyhkdb")


@lru_cache(maxsize=8192)
def _ops(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]


def _mismatch(ops: list[tuple[int, str]], seq: str | None, ref: str) -> tuple[str | None, int | None, str | None]:
    """(md, nm, equal_seq) of one read that begins with the reference's letters; without a sequence what needs one is None."""
    x = y = u = nm = 0
    md, shown, over = [], [], False
    for n, op in ops:
        if op in "M=X" and not over:
            if seq is None:
                return None, None, None
            over = x + n > len(ref)
            here, read = ref[x : x + n], seq[y : y + n]
            for r, f in zip_longest(read[: len(here)], here):
                if r == "=" or f == "=" or r is not None and r in KNOWN and r.upper() == f.upper():
                    u += 1
                    shown.append("=")
                else:
                    md += (str(u), f)
                    u, nm = 0, nm + 1
                    shown.append(r or "")
            shown.append(read[len(here) :])
            x, y = x + n, y + n
        elif op in "MIS=X":
            shown.append(None if seq is None else seq[y : y + n])
            nm += n if op == "I" and not over else 0
            y += n
        elif op == "D" and not over:
            over = x + n > len(ref)
            md += (str(u), "^", ref[x : x + n])
            u, nm, x = 0, nm + (0 if over else n), x + n
        elif op == "N" and not over:
            x += n
    return "".join([*md, str(u)]), nm, None if None in shown else "".join(shown)


def mismatches(sam: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds md, nm and equal_seq (the sequence with = where it says the reference's letter) to the mapped alignments; the others have null.

    md counts letters that agree, names the reference's letters that don't, and ^ and the letters of deletions. nm: mismatches, inserted and deleted
    letters. An operation that reaches beyond the reference ends the string after the last letter there; what follows does not count, nor does a deletion that reaches beyond. The exact forms
    of a match count as matches. Nothing is known on unknown references and of reads that begin beyond the end: null.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sam.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("flag", "cigar", "seq", "ref"))
            found = [(None, None, None) if flag is None or flag & UNMAPPED or cigar is None or ref is None else _mismatch(_ops(cigar), seq, ref) for flag, cigar, seq, ref in zip(*columns, strict=True)]
            own = [c for c in batch.schema.names if c not in ("ref_at", "ref")]
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], [*own, "md", "nm", "equal_seq"])

    return with_reference(sam, pieces).mapInArrow(run, f"{fields}, md string, nm int, equal_seq string")


# base alignment quality

#: Gap opening and extension, emission of an inserted letter, share of a mismatch for each other letter.
OPEN, EXTEND, INSERTED, MISMATCH = 0.001, 0.1, 0.25, 1 / 3
#: Band of a read without gaps.
BAND = 7
_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


def posteriors(refs: np.ndarray, sizes: np.ndarray, reads: np.ndarray, quals: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For reads of one length against stretches of the reference: of each letter the likeliest place (state, from 0), whether as an insertion, and its posterior.

    refs (n, widest) and reads (n, length): codes 0-3, 4 unknown; sizes: letters of each stretch. Global in the read, local in the stretch: any place begins and ends it. Band: |i - k| at most
    `bands` (raised to the difference of the lengths). All reads and all places of the band are one numpy step, a place's reads side by side; a row's deletions follow from a scan along
    the places.
    """
    n, length = reads.shape
    bands = np.minimum(np.maximum(sizes, length), bands)
    bands = np.maximum(bands, np.abs(sizes - length))
    most = int(bands.max())
    width = 2 * most + 1
    error = np.power(10.0, -quals / 10.0).T
    end = 1.0 / (2 * length + 2)
    mm, mg = (1 - 2 * OPEN) * (1 - end), OPEN * (1 - end)
    im, ii = (1 - EXTEND) * (1 - end), EXTEND * (1 - end)
    dm, dd = 1 - EXTEND, EXTEND
    begin_m, begin_i = (1 - OPEN) / sizes, OPEN / sizes
    # column c of letter i (from 1) is place k = i + c - most (from 1): rows i - 1 + c of the stretches with a margin; 5 is beyond them
    codes = np.full((length + width, n), 5, np.int8)
    at = min(refs.shape[1], length + width - most)
    codes[most : most + at] = np.where(np.arange(at)[:, None] < sizes, refs.T[:at], 5)
    inside, unknown = (codes < 5).astype(float), bool((codes == 4).any())
    near = None if (bands == most).all() else (np.abs(np.arange(width) - most)[:, None] <= bands).astype(float)

    def okay(i: int) -> np.ndarray:
        """1 for the places that are in the band and the stretch, else 0."""
        own = inside[i - 1 : i - 1 + width]
        return own if near is None else own * near

    def emission(i: int, ok: np.ndarray) -> np.ndarray:
        r, q, e = codes[i - 1 : i - 1 + width], reads[:, i - 1], error[i - 1]
        out = np.where(r == q.astype(np.int8), np.where(q > 3, 1.0, 1 - e), np.where(q > 3, 1.0, e * MISMATCH))
        if unknown:
            out[r == 4] = 1.0
        return out * ok

    fm, fi, es = (np.zeros((length + 1, width, n)) for _ in range(3))
    fd, scale = np.zeros((width, n)), np.ones((length + 2, n))
    for i in range(1, length + 1):
        ok = okay(i)
        es[i] = e = emission(i, ok)
        m, ins, d = fm[i], fi[i], np.zeros((width, n))
        if i == 1:
            np.multiply(e, begin_m, out=m)
            np.multiply(ok, INSERTED * begin_i, out=ins)
        else:
            # along a column k - i stays: a match comes from the same column, an insertion from the one after
            np.multiply(e, mm * fm[i - 1] + im * fi[i - 1] + dm * fd, out=m)
            ins[:-1] = INSERTED * (mg * fm[i - 1, 1:] + ii * fi[i - 1, 1:]) * ok[:-1]
            for c in range(1, width):
                d[c] = mg * m[c - 1] + dd * d[c - 1]
            d *= ok
        total = m.sum(axis=0) + ins.sum(axis=0) + d.sum(axis=0)
        scale[i] = total
        m /= total
        ins /= total
        fd = d / total
    scale[length + 1] = ((fm[length] + fi[length]) * end).sum(axis=0)
    state, inserted, best = (np.zeros((n, length), t) for t in (np.int64, bool, float))
    bm = bi = None
    for i in range(length, 0, -1):
        ok = okay(i)
        if i == length:
            bm = bi = ok * (end / scale[length] / scale[length + 1])
        else:
            e = es[i + 1] * bm * ok
            m, ins, d = e * mm, e * im, np.zeros((width, n))
            if i > 1:
                d[-1] = dm * e[-1]
                for c in range(width - 2, -1, -1):
                    d[c] = dm * e[c] + dd * d[c + 1]
                m[:-1] += mg * d[1:] * ok[1:]
            m[1:] += INSERTED * mg * bi[:-1]
            ins[1:] += INSERTED * ii * bi[:-1]
            bm, bi = m * ok / scale[i], ins * ok / scale[i]
        zm, zi = fm[i] * bm, fi[i] * bi
        top, place = np.maximum(zm[0], zi[0]), np.zeros(n, np.int64)
        for c in range(1, width):
            now = np.maximum(zm[c], zi[c])
            place[now > top] = c
            np.maximum(top, now, out=top)
        state[:, i - 1], inserted[:, i - 1] = i - 1 + place - most, zi[place, np.arange(n)] > zm[place, np.arange(n)]
        best[:, i - 1] = top / (zm.sum(axis=0) + zi.sum(axis=0))
    return state, inserted, best


def _window(ops: list[tuple[int, str]], pos: int, length: int) -> tuple[int, int, int] | None:
    """(begin, end, band) of the stretch of the reference that a read is aligned to; None for reads with a skip or without a match."""
    x, y, first = pos, 0, None
    last = (0, 0)
    for n, op in ops:
        if op in "M=X":
            first = (x, y) if first is None else first
            last = (x + n, y + n)
            x, y = x + n, y + n
        elif op in "SI":
            y += n
        elif op == "D":
            x += n
        elif op == "N":
            return None
    if first is None or y != length:
        return None
    (xb, yb), (xe, ye) = first, last
    apart = abs((xe - xb) - (ye - yb))
    band = BAND if apart <= BAND else apart + 3
    xb, xe = max(0, xb - yb - band // 2), xe + length - ye + band // 2
    if xe - xb - length > band:
        xb += (xe - xb - length - band) // 2
        xe -= (xe - xb - length - band) // 2
    return xb, xe, band


def _capped(ops, pos: int, begin: int, state, inserted, quality: np.ndarray, qual: np.ndarray, extended: bool) -> np.ndarray:
    """What a read's base qualities become: of matched letters the alignment quality where the likeliest place is the alignment's own, else 0, at most the quality itself."""
    out, x, y = qual.copy(), pos, 0
    for n, op in ops:
        if op in "M=X":
            at = np.arange(y, y + n)
            own = np.where(inserted[at] | (state[at] != x - begin + np.arange(n)), 0, quality[at])
            if extended:  # a letter counts as the better ones on either side do
                own = np.minimum(np.maximum.accumulate(own), np.maximum.accumulate(own[::-1])[::-1])
            out[at] = np.minimum(qual[at], own)
            x, y = x + n, y + n
        elif op in "SI":
            y += n
        elif op in "DN":
            x += n
    return out


#: Cells of the matrices that are held at once.
CELLS = 1 << 21


def alignment_qualities(sam: DataFrame, pieces: DataFrame, extended: bool = False) -> DataFrame:
    """Adds bq (what base qualities lose, as characters from @) and capped (the qualities less that) to alignments.

    The posteriors of a banded alignment of each read to the reference around it cap the qualities of its matched letters; extended: by the best on either side.
    Unmapped reads, those with a skip, without a match, a sequence or qualities, or whose cigar has another length, and those on
    unknown references have null. A certain place counts as 99. Reads of one length are aligned side by side; memory follows the longest read times its band.
    """
    room = F.coalesce(F.length("seq"), F.lit(0)) + F.coalesce(reference_length(F.col("cigar")), F.lit(0)) + 8
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sam.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            todo: dict[int, list] = {}
            columns = {c: batch.column(c).to_pylist() for c in ("flag", "pos", "cigar", "seq", "qual", "ref_at", "ref")}
            for i, (flag, pos, cigar, seq, qual, at, ref) in enumerate(zip(*columns.values(), strict=True)):
                if flag is None or flag & UNMAPPED or not seq or not qual or len(seq) != len(qual) or not ref or not cigar or not (ops := _ops(cigar)):
                    continue
                if (w := _window(ops, pos, len(seq))) is None:
                    continue
                stretch = ref[w[0] - at : w[1] - at]
                if stretch:
                    todo.setdefault(len(seq), []).append((i, ops, pos, w[0], stretch, w[2]))
            tags, quals = [None] * n, [None] * n
            for length, reads in todo.items():
                width = 2 * max(max(r[5], abs(len(r[4]) - length)) for r in reads) + 1
                per = max(1, CELLS // (length * width))
                for k in range(0, len(reads), per):
                    part = reads[k : k + per]
                    sizes = np.array([len(r[4]) for r in part])
                    refs = np.full((len(part), int(sizes.max())), 4)
                    for j, r in enumerate(part):
                        refs[j, : sizes[j]] = _CODE[np.frombuffer(r[4].encode("latin-1", "replace"), np.uint8)]
                    codes = np.stack([_CODE[np.frombuffer(columns["seq"][r[0]].encode("latin-1", "replace"), np.uint8)] for r in part])
                    base = np.stack([np.frombuffer(columns["qual"][r[0]].encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33 for r in part])
                    state, inserted, best = posteriors(refs, sizes, codes, base, np.array([r[5] for r in part]))
                    with np.errstate(divide="ignore"):
                        q = np.where(best < 1, np.floor(-4.343 * np.log(np.maximum(1 - best, 1e-300)) + 0.499), 99).astype(np.int64)
                    q = np.where(q > 100, 99, q)
                    for j, (i, ops, pos, begin, *_) in enumerate(part):
                        left = _capped(ops, pos, begin, state[j], inserted[j], q[j], base[j], extended)
                        tags[i] = bytes((base[j] - left + 64).astype(np.uint8)).decode("latin-1")
                        quals[i] = bytes((left + 33).astype(np.uint8)).decode("latin-1")
            own = [batch.column(c) for c in batch.schema.names if c not in ("ref_at", "ref")]
            names = [c for c in batch.schema.names if c not in ("ref_at", "ref")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(tags, pa.string()), pa.array(quals, pa.string())], [*names, "bq", "capped"])

    return with_reference(sam, pieces, room, room).mapInArrow(run, f"{fields}, bq string, capped string")
