"""Language ID by interpolated Kneser-Ney character models.

One model per language. All languages' n-grams stand in one sorted array per order, packed exactly into 64-bit keys,
with a row of log probabilities, one column per language: a position costs one binary search when its longest n-gram
was seen at all, and shorter ones are searched only for the rest. The language with the lowest cross-entropy per
character wins; a text whose cross-entropy is far above what its language's own texts have is rejected.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, held_out, stored, text_slices, trim, worker_cache

ORDER = 4
SPACE = 0x20
#: A first-order model shares what it discounts among so many characters.
ALPHABET = 1 << 16
UNKNOWN = "und"
#: Characters of a text that are folded, and symbols that are scored, at once.
LONG = 1 << 18
#: Symbols in a block of calibration, fewest set-aside texts that calibrate a language alone, and standard deviations up to which a text is not rejected.
BLOCK, ALONE, LIMIT = 16, 5, 12


@cache
def _folding() -> np.ndarray:
    """Code point -> 16-bit symbol: letters and marks stay (above 16 bits they are folded), all else is a space."""
    out = np.full(sys.maxunicode + 1, SPACE, np.uint16)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = c if c < 1 << 16 else 0xE000 + c % 6400
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 spaces, and each text's number of symbols without them; runs of other characters are one space, and so is a text's end."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("".join(t + "\0" for t in low).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in low])
    s = _folding()[raw]
    gap = s == SPACE
    first = np.ones(len(s), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.ones(len(s), bool)
    before[1:] = gap[:-1]
    keep = ~(gap & (before | first))
    s, owner = s[keep], owner[keep]
    n = np.bincount(owner, minlength=len(texts))
    out = np.full(len(s) + len(texts) * (ORDER - 1), SPACE, np.uint16)
    out[np.arange(len(s)) + (owner + 1) * (ORDER - 1)] = s
    return out, n


def long_symbols(text: str) -> np.ndarray:
    """symbols() of one text, folded piece by piece."""
    low, out = text.lower(), [np.full(ORDER - 1, SPACE, np.uint16)]
    for at in range(0, len(low), LONG):
        piece, after = low[at : at + LONG], low[at + LONG : at + LONG + 1]
        s = symbols([piece])[0][ORDER - 1 :]
        # a piece's end is a space; within the text it is one only if the next character or this piece's last is
        if after and _folding()[ord(after)] != SPACE and _folding()[ord(piece[-1])] != SPACE:
            s = s[:-1]
        if len(out) == 1 or not (len(s) and s[0] == SPACE and out[-1][-1] == SPACE):
            out.append(s)
        else:
            out.append(s[1:])
        if not len(out[-1]):
            out.pop()
    return np.concatenate(out)


def grams(s: np.ndarray) -> np.ndarray:
    """The packed ORDER-gram that ends at each symbol from ORDER - 1 on."""
    w = s.astype(np.uint64)
    g = w[: len(w) - ORDER + 1]
    for i in range(1, ORDER):
        g = (g << np.uint64(16)) | w[i : len(w) - ORDER + 1 + i]
    return g


def real(n: np.ndarray) -> np.ndarray:
    """Which of grams()' positions end at a text's own symbol, given the texts' symbol numbers."""
    out = np.ones(int(n.sum()) + len(n) * (ORDER - 1), bool)
    starts = np.concatenate([[0], np.cumsum(n + ORDER - 1)])[:-1]
    for i in range(ORDER - 1):
        out[starts + i] = False
    return out[ORDER - 1 :]


def _lookup(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, at, -1)


@dataclass
class LanguageModels:
    """Per order k from 1: sorted keys with log2 probabilities, and sorted contexts with log2 back-off weights, per language."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    logb: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray

    def costs(self, g: np.ndarray) -> np.ndarray:
        """Bits of each ORDER-gram's last symbol under each language."""
        at = _lookup(self.keys[ORDER - 1], g)
        out = np.empty((len(g), len(self.langs)), np.float32)
        seen = at >= 0
        out[seen] = self.logp[ORDER - 1][at[seen]]
        rest = np.flatnonzero(~seen)
        weight = np.zeros((len(rest), len(self.langs)), np.float32)
        for k in range(ORDER, 1, -1):
            if not len(rest):
                break
            mask = np.uint64((1 << 16 * (k - 1)) - 1)
            ctx = _lookup(self.contexts[k - 1], (g[rest] >> np.uint64(16)) & mask)
            weight[ctx >= 0] += self.logb[k - 1][ctx[ctx >= 0]]
            at = _lookup(self.keys[k - 2], g[rest] & mask)
            hit = at >= 0
            out[rest[hit]] = weight[hit] + self.logp[k - 2][at[hit]]
            rest, weight = rest[~hit], weight[~hit]
        out[rest] = weight + self.floor
        return -out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per symbol of each text under each language, and symbols per text. A long text is scored in blocks that overlap."""
        if len(texts) == 1 and len(texts[0]) > LONG:
            s = long_symbols(texts[0])
            n, total = len(s) - ORDER + 1, np.zeros(len(self.langs))
            for i in range(0, n, LONG):
                total += self.costs(grams(s[i : i + LONG + ORDER - 1])).sum(axis=0, dtype=np.float64)
            return (total / max(n, 1))[None], np.array([n])
        s, n = symbols(texts)
        out = np.zeros((len(texts), len(self.langs)))
        if len(self.langs) and n.any():
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.costs(grams(s))[real(n)], axis=0, dtype=np.float64)])
            ends = np.cumsum(n)
            out = (sums[ends] - sums[ends - n]) / np.maximum(n, 1)[:, None]
        return out, n

    def decide(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        ce, n = self.score(texts)
        got = []
        for t, c, k in zip(texts, ce, n.tolist(), strict=True):
            if not k or not len(self.langs) or not any(x.isalpha() for x in t):
                got.append((UNKNOWN, 0.0, 0.0, True))
                continue
            best = int(c.argmin())
            share = 1 / float(np.exp2(np.clip((c[best] - c) * k, -1000, 0)).sum())
            most = self.mean[best] + LIMIT * np.sqrt(self.spread[best] ** 2 + self.noise[best] ** 2 / k)
            got.append((self.langs[best], share, float(c[best]), bool(c[best] > most)))
        return got


def _one(keys: np.ndarray, counts: np.ndarray):
    """A language's (keys, log2 p, contexts, log2 back-off) per order, and its floor, from its ORDER-gram counts."""
    levels = [(keys, counts.astype(np.float64))]
    for k in range(ORDER - 1, 0, -1):
        u, c = np.unique(levels[0][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
        levels.insert(0, (u, c.astype(np.float64)))
    out, lower = [], None
    for k, (u, c) in enumerate(levels, 1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, first, types = np.unique(u >> np.uint64(16), return_index=True, return_counts=True)
        total = np.add.reduceat(c, first)
        back = d * types / total
        at = np.repeat(np.arange(len(ctx)), types)
        if lower is None:
            below = 1.0 / ALPHABET
            floor = np.log2(back[0] / ALPHABET)
        else:
            below = lower[1][np.searchsorted(lower[0], u & np.uint64((1 << 16 * (k - 1)) - 1))]
        p = (c - d) / total[at] + back[at] * below
        lower = (u, p)
        out.append((u, np.log2(p), ctx, np.log2(back)))
    return out, floor


def build(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
    """Models from sorted ORDER-gram keys and counts per language."""
    single = [_one(*counts[x]) for x in langs]
    keys, logp, contexts, logb = [], [], [], []
    floor = np.array([f for _, f in single], np.float32)
    for k in range(1, ORDER + 1):
        parts = [m[k - 1] for m, _ in single]
        u = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        ctx = np.unique(np.concatenate([p[2] for p in parts])) if parts else np.zeros(0, np.uint64)
        b = np.zeros((len(ctx), len(langs)), np.float32)
        p = np.empty((len(u), len(langs)), np.float32)
        for i, (own, lp, octx, lb) in enumerate(parts):
            b[np.searchsorted(ctx, octx), i] = lb
            if k == 1:
                p[:, i] = floor[i]
            else:  # what this language has not seen backs off
                mask = np.uint64((1 << 16 * (k - 1)) - 1)
                p[:, i] = b[np.searchsorted(ctx, u >> np.uint64(16)), i] + logp[-1][np.searchsorted(keys[-1], u & mask), i]
            p[np.searchsorted(u, own), i] = lp
        keys.append(u)
        logp.append(p)
        contexts.append(ctx)
        logb.append(b)
    n = len(langs)
    return LanguageModels(langs, keys, logp, contexts, logb, floor, np.full(n, np.inf), np.zeros(n), np.zeros(n))


def fit_languages(docs: DataFrame, per_language: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Models of every non-null language among documents that are not held out, from about `per_language` of each, chosen by hash.

    A tenth of the sample is left out of the counts and calibrates rejection (calibrate). What reaches the driver is bounded by the sample, whatever the corpus holds.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("d"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & ~held_out(F.col("d")))
    known = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return build([], {})
    share = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in known.items()], "sl string, share double")
    h = F.pmod(F.xxhash64("d", F.lit(3)), F.lit(1_000_000))
    sample = own.join(F.broadcast(share), F.col("lang") == F.col("sl")).filter(h < F.col("share") * 1_000_000)
    sample = stored(sample.select("lang", "text", (F.pmod(F.xxhash64("d", F.lit(4)), F.lit(10)) == 0).alias("aside")).filter("text IS NOT NULL"), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("languages", dict)
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for i, j in text_slices([len(t) for t in mine]):
                    s, n = symbols(mine[i:j])
                    if n.any():
                        k, c = np.unique(grams(s)[real(n)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "k", "c"])

    table = sample.filter("NOT aside").mapInArrow(count, "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c")).toArrow()
    whose, k, c = np.array(table["lang"].to_pylist()), table["k"].to_numpy().view(np.uint64), table["c"].to_numpy()
    langs = sorted(set(whose.tolist()))
    counts = {}
    for x in langs:
        at = np.flatnonzero(whose == x)
        at = at[np.argsort(k[at])]
        counts[x] = k[at], c[at]
    models = build(langs, counts)
    calibrate(models, _calibration(sample.filter("aside"), models).collect())
    return models


def calibrate(models: LanguageModels, told: list) -> None:
    """Sets each language's mean, its texts' spread about it and the noise of a symbol from sums over set-aside texts.

    A language with under ALONE such texts takes the spread and the noise of all languages together, and their mean if it has none.
    Without any set-aside text nothing is rejected.
    """
    of = {r["lang"]: np.array([r[x] or 0.0 for x in ("k", "n", "bits", "square", "blocks", "bm", "bs")]) for r in told}
    fits = {}
    for lang, x in [*of.items(), (None, sum(of.values()) if of else None)]:
        if x is None or not x[1]:
            continue
        k, n, bits, square, blocks, bm, bs = x
        mean = bits / n
        noise2 = BLOCK * max(bs / blocks - (bm / blocks) ** 2, 0.0) if blocks else (2 * mean) ** 2
        fits[lang] = k, mean, math.sqrt(max(square / n - mean**2 - noise2 * k / n, 0.05**2)), math.sqrt(noise2)
    if None in fits:
        for i, lang in enumerate(models.langs):
            own, every = fits.get(lang, fits[None]), fits[None]
            models.mean[i], (models.spread[i], models.noise[i]) = own[1], (own if own[0] >= ALONE else every)[2:]


def _calibration(rows: DataFrame, models: LanguageModels) -> DataFrame:
    """Per language: texts (k), symbols (n), their bits, sum over texts of n times the squared mean (square), and number, sum and squares of the means over blocks of BLOCK symbols."""
    held = rows.sparkSession.sparkContext.broadcast(models)
    names = ["k", "n", "bits", "square", "blocks", "bm", "bs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            langs, texts, at = b.column("lang").to_pylist(), b.column("text").to_pylist(), []
            for lang, t in zip(langs, texts, strict=True):
                if lang not in m.langs:
                    continue
                s = long_symbols(t)
                sums = np.zeros(len(names))
                for i in range(0, len(s) - ORDER + 1, LONG):
                    c = m.costs(grams(s[i : i + LONG + ORDER - 1]))[:, m.langs.index(lang)].astype(np.float64)
                    means = c[: len(c) // BLOCK * BLOCK].reshape(-1, BLOCK).mean(axis=1)
                    sums += [0, len(c), c.sum(), 0, len(means), means.sum(), (means * means).sum()]
                if sums[1]:
                    sums[0], sums[3] = 1, sums[2] ** 2 / sums[1]
                    at.append((lang, *sums))
            yield pa.RecordBatch.from_arrays([pa.array([r[q] for r in at], pa.string() if not q else pa.float64()) for q in range(len(names) + 1)], ["lang", *names])

    got = rows.mapInArrow(run, "lang string, " + ", ".join(f"{c} double" for c in names))
    return got.groupBy("lang").agg(*[F.sum(c).alias(c) for c in names])


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the language's share of the likelihood), bits, rejected.

    A null text or one without a letter: `und`, score 0, rejected; so is every text if nothing was learned. Other texts get
    the best learned language even if rejected. Whole texts are scored. Null ids are not held out. Repeated rows agree.
    Columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits double, rejected boolean"
    return rows.mapInArrow(_decider(docs.sparkSession, models, ["doc_id", "held_out"]), schema)


def _decider(spark, models: LanguageModels, passed: list[str], texts_of=lambda b: b.column("text")):
    """texts_of: the texts in a batch."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("languages", dict)
        for b in batches:
            texts = [t or "" for t in texts_of(b).to_pylist()]
            for i, j in text_slices([len(t) for t in texts], LONG):
                lang, score, bits, out = zip(*held.value.decide(texts[i:j]), strict=True)
                cols = [b.column(c).slice(i, j - i) for c in passed]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang), pa.array(score), pa.array(bits), pa.array(out)], [*passed, "lang_pred", "score", "bits", "rejected"])
        trim()

    return run


def keep_identified(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns, in one pass: rows go through the models whole."""
    rows, at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    schema = rows.schema
    fields = "lang_pred string, score double, bits double, rejected boolean"
    marked = rows.mapInArrow(_decider(docs.sparkSession, models, ["row"], lambda b: b.column("row").field(at)), f"row {schema['row'].dataType.simpleString()}, {fields}")
    return marked.filter("NOT rejected").select("row.*")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_languages(docs))
