"""Genotype likelihoods from the bases that reads lay on each position.

A position's bases are a histogram over (base, quality, strand), which is counted where the reads lie and added up across tasks: a row a
combination, some 700 at most, however deep a position is. Errors of one strand and base depend on each other: each
further one weighs less, and its chance is that of so many errors or more among all bases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import apply_cigar, has_flag, reference_length
from ..functions.distributions import lgamma
from .alignments import REVERSE, UNMAPPED
from .reference import MET, _cut, _glued, _ops

# Fixed values of the error model: dependence of errors, the share that never fades, and the qualities' bounds.
THETA, ETA = 0.83, 0.03
LEAST_QUALITY, MOST_QUALITY = 4, 63
#: Mapping quality that counts where it is not known (255), and the most that counts.
UNKNOWN_MAPQ, MOST_MAPQ = 20, 60
BASES = "ACGT"
#: Codes of a base that says the reference's, and of one that is left out for its quality.
AS_REFERENCE, LEFT_OUT = 5, -1


#: Positions whose reads are counted together, and the reads on them beyond which they are counted where they are.
PLACE, DEEP = 256, 1 << 22
#: Of the reference's tiles: letters, and how many are broadcast at most.
TILE, FEW = 1024, 1 << 13
_CELL = "sample string, base int, q int, strand int, n bigint"


def _reads(sam: DataFrame, sample: str | None) -> DataFrame:
    name = F.lit("") if sample is None else F.coalesce(F.col(sample).cast("string"), F.lit(""))
    mapq = F.least(F.when(F.col("mapq") == 255, UNKNOWN_MAPQ).otherwise(F.col("mapq")), F.lit(MOST_MAPQ))
    reads = sam.filter(~has_flag(F.col("flag"), UNMAPPED) & (F.length("seq") == F.length("qual")) & F.col("cigar").isNotNull())
    return reads.select(name.alias("sample"), "rname", F.col("pos").cast("long").alias("at"), mapq.alias("mapq"), has_flag(F.col("flag"), REVERSE).cast("int").alias("strand"), "cigar", "seq", "qual")


def _counted(reads: DataFrame, least_quality: int) -> DataFrame:
    """base_counts on the place `t` of each of the reads, counted where they are."""
    letters = lambda c: F.split(apply_cigar(F.col("cigar"), F.col(c), " "), "")
    laid = reads.select("sample", "rname", "at", "t", "mapq", "strand", F.posexplode(F.arrays_zip(letters("seq").alias("b"), letters("qual").alias("c"))).alias("i", "x"))
    laid = laid.filter((F.col("x.b") != " ") & (F.col("x.b") != "") & F.floor((F.col("at") + F.col("i")) / PLACE).eqNullSafe(F.col("t")))
    quality = F.ascii("x.c") - 33
    base = F.when(F.col("x.b") == "=", AS_REFERENCE).otherwise(F.coalesce(F.nullif(F.instr(F.lit(BASES), F.upper("x.b")), F.lit(0)) - 1, F.lit(4)))
    kept = quality >= least_quality
    q = F.greatest(F.least(quality, F.col("mapq"), F.lit(MOST_QUALITY)), F.lit(LEAST_QUALITY))
    cells = laid.select("sample", "rname", (F.col("at") + F.col("i")).alias("pos"), F.when(kept, base).otherwise(LEFT_OUT).alias("base"), F.when(kept, q).otherwise(0).alias("q"), F.when(kept, F.col("strand")).otherwise(0).alias("strand"))
    return cells.groupBy("sample", "rname", "pos", "base", "q", "strand").agg(F.count("*").alias("n"))


#: A base's code by its letter.
_BASE = np.full(128, 4, np.int64)
for _i, _c in enumerate(BASES):
    _BASE[[ord(_c), ord(_c.lower())]] = _i
_BASE[ord("=")] = AS_REFERENCE
#: Samples that a place may have, as room in its keys.
_SAMPLES = 1 << 20


def _laid(cigar: str, text: str) -> str:
    """apply_cigar in Python, with blanks for gaps."""
    out, y = [], 0
    for n, op in _ops(cigar):
        if op in "M=X":
            out.append(text[y : y + n])
        elif op in "DN":
            out.append(" " * n)
        y += n if op in "M=XIS" else 0
    return "".join(out)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return keys, sums


def _histograms(reads: DataFrame, least_quality: int) -> DataFrame:
    """(rname, pos, cells) of reads with the place `t` that each is to be counted on: a partition's places one by one, each from histograms of batches."""

    def keyed(columns: dict[str, list], t: int, codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        seqs, quals = ([_laid(c, x) for c, x in zip(columns["cigar"], columns[k], strict=True)] for k in ("seq", "qual"))
        sizes = np.array([len(x) for x in seqs])
        letters, quality = (np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (seqs, quals))
        quality = quality - 33
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) + np.repeat(np.array(columns["at"]) - t * PLACE - np.cumsum(sizes) + sizes, sizes)
        here = (pos >= 0) & (pos < PLACE) & (letters != 32)
        row, pos, letters, quality = row[here], pos[here], letters[here], quality[here]
        base = np.where(letters < 128, _BASE[np.minimum(letters, 127)], 4)
        q = np.maximum(np.minimum(np.minimum(quality, np.array(columns["mapq"])[row]), MOST_QUALITY), LEAST_QUALITY)
        strand, who = np.array(columns["strand"])[row], np.array([codes.setdefault(x, len(codes)) for x in columns["sample"]])[row]
        kept = quality >= least_quality
        cell = np.where(kept, ((base + 1) * 64 + q) * 2 + strand, (LEFT_OUT + 1) * 128)
        return np.unique((pos * _SAMPLES + who) * 1024 + cell, return_counts=True)

    def rows(rname: str | None, t: int, parts: list, codes: dict[str, int]) -> pa.RecordBatch:
        keys, n = _merged(parts)
        pos, who, cell = keys // 1024 // _SAMPLES, keys // 1024 % _SAMPLES, keys % 1024
        firsts = np.flatnonzero(np.diff(pos, prepend=-1))
        names = pa.DictionaryArray.from_arrays(pa.array(who, pa.int32()), pa.array(list(codes), pa.string())).cast(pa.string())
        fields = {"sample": names, "base": pa.array(cell // 128 + LEFT_OUT, pa.int32()), "q": pa.array(cell // 2 % 64, pa.int32()), "strand": pa.array(cell % 2, pa.int32()), "n": pa.array(n, pa.int64())}
        cells = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(keys)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        return pa.RecordBatch.from_arrays([pa.array([rname] * len(firsts), pa.string()), pa.array(pos[firsts] + t * PLACE, pa.int64()), cells], ["rname", "pos", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, codes, held = None, [], {}, 0
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            places = list(zip(columns["rname"], columns["t"], strict=True))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if places[i] != place:
                    if held:
                        yield rows(*place, parts, codes)
                    place, parts, codes, held = places[i], [], {}, 0
                parts.append(keyed({c: v[i:j] for c, v in columns.items()}, place[1], codes))
                held += len(parts[-1][0])
                if len(parts) > 1 and held > 2 * len(parts[0][0]) + (1 << 20):
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
        if held:
            yield rows(*place, parts, codes)

    return reads.repartition("rname", "t").sortWithinPartitions("rname", "t").mapInArrow(run, f"rname string, pos long, cells array<struct<{_CELL.replace(' ', ':').replace(',:', ',')}>>")


def _places(sam: DataFrame, least_quality: int, sample: str | None) -> tuple[DataFrame, DataFrame | None, int]:
    """(rname, pos, cells); the places (rname, t) that reads lie on, if the driver can hold their names, and how many there are."""
    reads = _reads(sam, sample)
    last = F.floor((F.col("at") + F.greatest(reference_length(F.col("cigar")), F.lit(1)) - 1) / PLACE)
    laid = reads.withColumn("t", F.explode_outer(F.sequence(F.floor(F.col("at") / PLACE), last)))
    met = laid.groupBy("rname", "t").agg(F.count("*").alias("n"))
    rows = met.limit(MET + 1).collect()
    few, odd = len(rows) <= MET, F.col("t").isNull() | (F.col("n") > DEEP)
    deep = [r for r in rows if r["t"] is None or r["n"] > DEEP] if few else met.filter(odd).collect()
    spots = sam.sparkSession.createDataFrame(rows, met.schema) if few else None
    if not deep:
        return _histograms(laid, least_quality), spots, len(rows)
    those = F.broadcast(sam.sparkSession.createDataFrame(deep, met.schema).select(F.col("rname").alias("_r"), F.col("t").alias("_d")))
    same = F.col("rname").eqNullSafe(F.col("_r")) & F.col("t").eqNullSafe(F.col("_d"))
    own = _counted(laid.join(those, same, "left_semi"), least_quality).groupBy("rname", "pos").agg(F.collect_list(F.struct("sample", "base", "q", "strand", "n")).alias("cells"))
    return _histograms(laid.join(those, same, "left_anti"), least_quality).union(own), spots, len(rows)


def base_counts(sam: DataFrame, least_quality: int = 13, sample: str | None = None) -> DataFrame:
    """(sample, rname, pos, base, q, strand, n): how many bases mapped reads lay on each position.

    base: 0-3 for ACGT, 4 for another letter, 5 for =, -1 below the least quality (then q and strand are 0). q: the base's quality, at most the mapping quality. Deleted
    and skipped positions have none. Reads without a sequence, or whose qualities are of another length, have none. sample: a column that tells samples apart.
    """
    cells = _places(sam, least_quality, sample)[0].select("rname", "pos", F.inline("cells"))
    return cells.select("sample", "rname", "pos", "base", "q", "strand", "n")


#: Cells of the tables of costs that are held at once, and the errors of a strand and base after which the weight is ETA.
CELLS, FADED = 1 << 20, 256


def _costs(q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(most n + 1, pairs): for k errors so far among n bases of quality q, what one more costs: -10 log10 of P(more than k) / P(k or more); 0 from n on. n rises.

    With h the chance of just k among k or more and r the ratio of the chances of k + 1 and k, h(k) = h(k + 1) / (h(k + 1) + r(k)), from h(n) = 1 down.
    """
    p = 10 ** (-q / 10)
    odds, most = p / (1 - p), int(n[-1])
    t, h = np.zeros((most + 1, len(n))), np.ones(len(n))
    firsts = np.searchsorted(n, np.arange(most), side="right").tolist()
    for k in range(most - 1, -1, -1):
        a = firsts[k]
        x = np.divide(h[a:] * (k + 1), (n[a:] - k) * odds[a:], out=t[k, a:])
        h[a:] = x / (1 + x)
    return np.log1p(t, out=t) * (10 / math.log(10))


def _sums(unit: np.ndarray, units: int, base: np.ndarray, q: np.ndarray, strand: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, 5) twice: of each unit's histogram, the bases 0-4 and what they cost as errors."""

    def before(*keys: np.ndarray) -> np.ndarray:
        """For each cell, the bases of those ahead of it that share all keys but the first, by falling first key."""
        order = np.lexsort(keys)
        ahead = np.cumsum(n[order]) - n[order]
        new = np.any([np.diff(k[order], prepend=-1) != 0 for k in keys[-1:]], axis=0)
        out = np.empty(len(n), np.int64)
        out[order] = ahead - ahead[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
        return out

    slot = unit * 5 + base
    own = np.bincount(slot, n, units * 5).astype(np.int64).reshape(units, 5)
    k0, w0 = before(-strand, -q, slot), before(-q, slot * 2 + strand)
    pair = own.sum(axis=1)[unit] * 256 + q
    order = np.argsort(pair, kind="stable")
    pairs, at = np.unique(pair[order], return_index=True)
    at = np.append(at, len(order))
    weight = THETA ** np.arange(FADED) * (1 - ETA)
    cost, i = np.zeros(len(n)), 0
    while i < len(pairs):
        j = i + 1
        while j < len(pairs) and (j + 1 - i) * (pairs[j] // 256 + 1) <= CELLS:
            j += 1
        table = _costs(pairs[i:j] % 256, pairs[i:j] // 256)
        mine = order[at[i] : at[j]]
        col = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        upto = np.zeros((table.shape[0] + 1, j - i))
        np.cumsum(table, axis=0, out=upto[1:])
        k, m = k0[mine], n[mine]
        early = np.clip(FADED - w0[mine], 0, m)
        row = np.repeat(np.arange(len(mine)), early)
        step = np.arange(len(row)) - np.repeat(np.cumsum(early) - early, early)
        fading = np.bincount(row, weight[w0[mine][row] + step] * table[k[row] + step, col[row]], len(mine))
        cost[mine] = ETA * (upto[k + m, col] - upto[k, col]) + fading
        i = j
    return own, np.bincount(slot, cost, units * 5).reshape(units, 5)


def _genotypes(own: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """(units, 5, 5): -10 log10 likelihoods of the genotypes over A, C, G, T and other, up to a constant."""
    out = np.empty((len(own), 5, 5))
    logs = lambda x: lgamma((u := np.unique(x, return_inverse=True))[0] + 1.0)[u[1].reshape(x.shape)]
    total, single = cost.sum(axis=1), logs(own)
    for j in range(5):
        for k in range(j, 5):
            v = total - cost[:, j] - (cost[:, k] if k != j else 0)
            if k != j:
                both = own[:, j] + own[:, k]
                v = v - 4.343 * (logs(both) - single[:, j] - single[:, k] - both * math.log(2))
            out[:, k, j] = out[:, j, k] = np.maximum(v, 0.0)
    return out


def likelihoods(base: np.ndarray, q: np.ndarray, strand: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(5, 5): -10 log10 likelihoods of the genotypes over A, C, G, T and other, up to a constant, from a histogram of bases 0-4."""
    return _genotypes(*_sums(np.zeros(len(base), np.int64), 1, *(np.asarray(x, np.int64) for x in (base, q, strand, n))))[0]


def alleles(sums: list[int], ref: int) -> tuple[list[int], bool]:
    """The reference's allele and the others by falling sum of qualities (the later letter of equal ones first), and whether the last one is a letter that was not seen."""
    others = sorted((b for b in range(4) if b != ref), key=lambda b: (-sums[b], -b))
    seen = [b for b in others if sums[b]]
    rest = others[len(seen) :]
    return [ref, *seen, *rest[:1]], bool(rest)


def genotype_likelihoods(counts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(rname, pos, ref, alts, sample, depth, all_depth, pl) from base_counts, a row per position and sample that has bases there.

    alts: letters between commas, X for one that stands for all that were not seen. pl: scaled likelihoods of the genotypes of the alleles, in the order 00, 01, 11, 02, ...; the
    likeliest is 0, at most 255. Alleles are those of all samples together. depth: bases that count; all_depth: with those of low quality. On
    unknown references the letter is N. Any depth is computed whole. Positions where no sample has a base that counts have no row.
    """
    cell = F.struct("sample", "base", "q", "strand", "n")
    return _called(counts.groupBy("rname", "pos").agg(F.collect_list(cell).alias("cells")), _glued(_cut(pieces, TILE, 0)).hint("merge"))


def genotypes(sam: DataFrame, pieces: DataFrame, least_quality: int = 13, sample: str | None = None) -> DataFrame:
    """genotype_likelihoods of alignments, whose positions are not dealt out again after counting; only the reference's tiles under them are laid out."""
    places, spots, n = _places(sam, least_quality, sample)
    parts = _cut(pieces, TILE, 0)
    if spots is not None:
        parts = parts.join(F.broadcast(spots.select(F.col("rname").alias("name"), F.floor(F.col("t") * PLACE / TILE).alias("t")).distinct()), ["name", "t"], "left_semi")
    return _called(places, F.broadcast(_glued(parts)) if n <= FEW else _glued(parts).hint("merge"))


#: Cells of histograms that are turned into likelihoods at once.
AT_ONCE = 1 << 19


def _called(places: DataFrame, letters: DataFrame) -> DataFrame:
    own = letters.withColumnsRenamed({"name": "_n", "t": "_t"})
    met = places.join(own, (F.col("rname") == F.col("_n")) & (F.floor(F.col("pos") / TILE) == F.col("_t")), "left")
    ref = F.coalesce(F.nullif(F.upper(F.substring("letters", (F.col("pos") % TILE + 1).cast("int"), F.lit(1))), F.lit("")), F.lit("N"))
    rows = met.select("rname", "pos", ref.alias("ref"), "cells")

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("rname", "pos", "ref", "alts", "sample", "depth", "all_depth", "pl")}
        codes = np.array([BASES.find(r) if r in BASES else 4 for r in batch.column("ref").to_pylist()], np.int64)
        cells = batch.column("cells").flatten()
        place = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("cells").offsets.to_numpy()))
        base, q, strand, n = (cells.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("base", "q", "strand", "n"))
        coded = cells.field("sample").dictionary_encode()
        names = coded.dictionary.to_pylist()
        rank = np.argsort(sorted(range(len(names)), key=names.__getitem__))
        names.sort()
        base = np.where(base == AS_REFERENCE, codes[place], base)
        units, unit = np.unique(place * len(names) + rank[coded.indices.to_numpy()], return_inverse=True)
        counted = base != LEFT_OUT
        depth, all_depth = (np.bincount(unit[x], n[x], len(units)).astype(np.int64) for x in (counted, slice(None)))
        sums = np.bincount(place[counted] * 5 + base[counted], (q * n)[counted], batch.num_rows * 5).astype(np.int64).reshape(-1, 5)
        p = _genotypes(*_sums(unit[counted], len(units), *(x[counted] for x in (base, q, strand, n))))
        columns = [batch.column(c).to_pylist() for c in ("rname", "pos", "ref")]
        for u in np.flatnonzero(depth).tolist():
            i, who = divmod(int(units[u]), len(names))
            code = int(codes[i])
            order, unseen = alleles(sums[i, :4].tolist(), code)
            alts = [BASES[b] for b in order[1:]]
            if unseen:
                alts[-1] = "X"
            values = np.array([p[u, order[j], order[k]] for k in range(len(order)) for j in range(k + 1)])
            pl = np.minimum(np.floor(values - values.min() + 0.499), 255).astype(int).tolist()
            for c, v in zip(out, (columns[0][i], columns[1][i], columns[2][i] if code < 4 else "N", ",".join(alts), names[who], int(depth[u]), int(all_depth[u]), pl), strict=True):
                out[c].append(v)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, i = batch.column("cells").offsets.to_numpy(), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + AT_ONCE, side="right")) - 1)
                yield some(batch.slice(i, j - i))
                i = j

    return rows.mapInArrow(run, "rname string, pos long, ref string, alts string, sample string, depth long, all_depth long, pl array<int>")
