"""Benchmark decontamination by template canonicalisation.

Numbers, quantities with units and names become typed placeholders, so that a question with other values has the
same template. Windows of template words are hash-joined with the benchmark's; along each alignment of a document
with an item the slots must be filled consistently: the same value in the item is the same value in the document.
Windows with few literal words count beside a literal one or where the whole item's template is met; items that have such
windows, and items of few words, are also met by windows of their plain words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, stored, trim, utf8_column, worker_cache

WINDOW = 8
#: Fewest literal words in a window that counts alone, as a share: windows of placeholders would match anything.
LITERAL = 0.5
#: An item shorter than this is met verbatim only.
SHORTEST = 4
# Words that make a number before them a quantity.
UNITS = frozenset(
    "km m cm mm mile miles mi ft feet foot inch inches yard yards kg g mg lb lbs pound pounds oz ton tons "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph kmh kph percent dollar dollars cent cents euro euros usd eur hz khz mhz w kw kwh v a c f".split()
)
WORD, NAME, NUMBER, UNIT, QUANTITY, NONE = range(6)
_EDGES = b" .,!?;:|*#%&$\"'()[]{}<>=+~^_`-/\\"
_NUMBER = re.compile(r"[+-]?[$£€]?\d+(?:[.,:/]\d+)*%?")
_QUANTITY = re.compile(r"[+-]?[$£€]?\d+(?:[.,:/]\d+)*([A-Za-zµ]+)")
_DIGIT = re.compile(rb"[0-9]")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Distinct raw tokens that a worker remembers; beyond it the half that was met last goes: the commonest are met first.
MEMO = 300_000


class _Memo(dict):
    """Looks a token up, or learns it."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, raw: bytes) -> int:
        return self.learn(raw)


class Tokens:
    """Raw token -> its place in the arrays of kinds, hashes of the lower-case words, and whether they end a sentence; a token that is remembered is looked at once."""

    def __init__(self):
        self.memo = _Memo(self._learn)
        self.kind, self.hash, self.stop = np.zeros(1024, np.int8), np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def _learn(self, raw: bytes) -> int:
        i = len(self.memo)
        if i == len(self.kind):
            self.kind, self.hash, self.stop = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.hash, self.stop))
        bare = raw.strip(_EDGES).decode("utf-8", "replace")
        low = bare.lower()
        if not bare:
            kind = NONE
        elif _DIGIT.search(raw) and (found := self._number(raw, bare)) is not None:
            kind = found
        elif low in UNITS:
            kind = UNIT
        elif low != bare and bare[0].isupper() and any(c.islower() for c in bare):
            kind = NAME
        else:
            kind = WORD
        self.kind[i], self.stop[i] = kind, raw.rstrip(b"\"')*#%&$|").endswith((b".", b"!", b"?", b":"))
        self.hash[i] = _hash(low.encode())
        self.memo[raw] = i
        return i

    @staticmethod
    def _number(raw: bytes, bare: str) -> int | None:
        money = raw.decode("utf-8", "replace").strip(" .,!?;:|*#&\"'()")
        if _NUMBER.fullmatch(money) or _NUMBER.fullmatch(bare):
            return QUANTITY if money[:1] in "$£€" or money.endswith("%") else NUMBER
        found = _QUANTITY.fullmatch(bare)
        return QUANTITY if found and found[1].lower() in UNITS else None

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            for raw in list(self.memo)[MEMO // 2 :]:
                del self.memo[raw]
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


_SLOT = {k: np.uint64(_hash(b"\0slot%d" % k)) for k in (NAME, NUMBER, QUANTITY)}


def _tokens() -> Tokens:
    """A worker's own: what one task has learned serves the next."""
    return worker_cache("templates", Tokens)


@dataclass
class Template:
    """Hashes and kinds of a text's template words, where each begins and ends among the raw words, and the plain words' hashes."""

    hash: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    plain: np.ndarray

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of template words; of plain words if the width is negative."""
        words, width = (self.hash, width) if width > 0 else (self.plain, -width)
        n = len(words) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        h = np.full(n, width, np.uint64)
        for j in range(width):
            h = (h ^ words[j : j + n]) * _MULT
            h ^= h >> np.uint64(29)
        return h

    def literal(self, width: int) -> np.ndarray:
        """Which windows of template words have enough literal ones."""
        words = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        return words[width:] - words[:-width] >= LITERAL * width

    def slots(self, words: list[bytes], at: int, width: int) -> list[str]:
        """The values in a window's placeholders, in order."""
        out = []  # none of plain words
        for i in range(at, at + width):
            if self.kind[i] != WORD:
                out.append(b" ".join(w.strip(_EDGES) for w in words[self.begin[i] : self.end[i]]).decode("utf-8", "replace").lower())
        return out


def template(words: list[bytes], tokens: Tokens) -> Template:
    """Canonicalises a text. A capital word is a name unless it begins a sentence; names in a row are one, a number and its unit too."""
    i = tokens.ids(words)
    kind = tokens.kind[i].copy()
    keep = kind != NONE
    at = np.flatnonzero(keep)
    kind, hashes = kind[keep], tokens.hash[i][keep]
    # a mark that stands alone still ends the sentence before it
    stops = np.concatenate([[0], np.cumsum(tokens.stop[i])])
    after = np.ones(len(at), bool)
    after[1:] = stops[at[1:]] > stops[at[:-1]]
    kind[(kind == NAME) & after] = WORD
    follows = np.zeros(len(at), bool)
    follows[1:] = (kind[:-1] == NUMBER) & (kind[1:] == UNIT)
    kind[:-1][follows[1:]] = QUANTITY
    kind[(kind == UNIT) & ~follows] = WORD
    same = np.zeros(len(at), bool)
    same[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~after[1:]
    first = np.flatnonzero(~(follows | same))
    k, h = kind[first], hashes[first]
    for slot, value in _SLOT.items():
        h[k == slot] = value
    return Template(h, k, at[first], np.append(at[first][1:], len(words)), hashes)


def benchmark_windows(items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, item_id, ipos, width, islots, windows, literal, whole): every window of every item. Items of SHORTEST to width - 1 words are one window.

    literal: the window counts alone; whole: the item may be met by its whole template, as it has a literal word. Where not all windows
    are literal, or the template has under SHORTEST words, windows of plain words follow, with the width negated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens()
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), utf8_column(b, "text"), strict=True):
                words = text.split()
                t = template(words, tokens)
                w, exact = min(width, len(t.hash)), True
                if w >= SHORTEST:
                    h, literal, whole = t.windows(w), t.literal(w).tolist(), bool((t.kind == WORD).any())
                    rows += [(x, item, p, w, t.slots(words, p, w), len(h), literal[p], whole) for p, x in enumerate(h.view("<i8").tolist())]
                    exact = not all(literal)
                if exact and len(t.plain):
                    w = min(width, len(t.plain))
                    h = t.windows(-w)
                    rows += [(x, item, p, -w, [], len(h), True, True) for p, x in enumerate(h.view("<i8").tolist())]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.bool_()]
                names = ["h", "item_id", "ipos", "width", "islots", "windows", "literal", "whole"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "h long, item_id long, ipos int, width int, islots array<string>, windows int, literal boolean, whole boolean")


def _sieve(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A table of 2 ** bits flags, set where some window's hash falls, and its shift; at most 2 ** 26, whatever the benchmark's size."""
    bits = min(26, max(16, int(windows.count() * 64).bit_length()))
    flags = np.zeros(1 << bits, bool)
    for r in windows.select(F.shiftrightunsigned(F.col("h"), 64 - bits).alias("x")).distinct().toLocalIterator():
        flags[r.x] = True
    return flags, 64 - bits


def contamination(
    docs: DataFrame, items: DataFrame, width: int = WINDOW, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, rephrased): documents that hold at least `least` of an item's windows.

    Windows count along alignments whose slots are consistent; rephrased: some slot has another value than the item's. Along an alignment
    without a literal window all of the item's windows must be met. Windows of plain words make a coverage of their own; the larger one counts.
    All windows of whole texts are looked up. A table of flags of bounded size is broadcast and sieves
    them first; what passes is joined by hash, and Catalyst picks the join by size. Null and empty texts and items
    without a word match nothing; items under SHORTEST words match wherever they stand verbatim; null ids are kept; repeated rows count once; extra columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = stored(benchmark_windows(items, width, item_col, item_text_col), "windows")
    widths = [r.width for r in known.select("width").distinct().collect()]
    sieve = spark.sparkContext.broadcast(_sieve(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (flags, shift), tokens = sieve.value, _tokens()
        for b in batches:
            rows = []
            for d, th, text in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), utf8_column(b, "text"), strict=True):
                words = text.split()
                t = template(words, tokens)
                for w in widths:
                    h = t.windows(w)
                    hit = np.flatnonzero(flags[(h >> np.uint64(shift)).astype(np.int64)])
                    rows += [(d, th, int(x), int(p), w, t.slots(words, p, w)) for p, x in zip(hit, h[hit].view("<i8"), strict=True)]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "text_hash", "dh", "dpos", "dw", "dslots"])
        trim()

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("text_hash", F.xxhash64("text"))
    hits = rows.mapInArrow(run, "doc_id long, text_hash long, dh long, dpos int, dw int, dslots array<string>")
    met = hits.join(known, (F.col("dh") == F.col("h")) & (F.col("dw") == F.col("width"))).filter(F.size("dslots") == F.size("islots"))
    # an alignment has at most an item's windows: the sets below are bounded by the item's length
    fills, some = F.arrays_zip("islots", "dslots"), F.col("literal")
    flat = lambda x: F.array_distinct(F.flatten(F.collect_set(x)))
    along = met.groupBy("doc_id", "text_hash", "item_id", "width", (F.col("dpos") - F.col("ipos")).alias("offset")).agg(
        F.collect_set("ipos").alias("every"), flat(fills).alias("fills"),
        F.collect_set(F.when(some, F.col("ipos"))).alias("sure"), flat(F.when(some, fills)).alias("sure_fills"),
        F.max("windows").alias("windows"), F.max("whole").alias("whole"),
    )
    consistent = lambda x: F.size(x) == F.size(F.array_distinct(F.transform(x, lambda v: v["islots"])))
    differs = lambda x: F.exists(x, lambda v: v["islots"] != v["dslots"])
    anchored, full = F.size("sure") > 0, F.col("whole") & (F.size("every") == F.col("windows"))
    counted = (
        F.when(consistent("fills") & (anchored | full), F.struct(F.col("every").alias("at"), differs("fills").alias("other")))
        .when(anchored & consistent("sure_fills"), F.struct(F.col("sure").alias("at"), differs("sure_fills").alias("other")))
    )
    kept = along.withColumn("counted", counted).filter("counted IS NOT NULL").select("doc_id", "text_hash", "item_id", "width", "windows", "counted.*")
    found = kept.select("doc_id", "text_hash", "item_id", "width", "windows", "other", F.explode("at").alias("p")).groupBy("doc_id", "text_hash", "item_id", "width").agg(
        (F.count_distinct("p") / F.max("windows")).alias("coverage"), F.max("other").alias("rephrased")
    )
    found = found.filter(F.col("coverage") >= least).groupBy("doc_id", "text_hash", "item_id")
    return found.agg(F.max("coverage").alias("coverage"), F.max("rephrased").alias("rephrased"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    found = stored(contamination(docs, items, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_hash").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    return rows.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("text_hash")), "left_anti").select("row.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, best (largest share of an item's windows)."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.max("coverage").alias("best"))
