"""Interaction of document filters: what each removes, in every order in which they can be applied.

Texts are scanned in Arrow's buffers: a table gives each byte's class, prefix sums give words, capitals, symbols and code points
of each text, and a text's distinct words come from its sorted word hashes, verified byte by byte. A document becomes a mask of the filters that
it fails; a part's counts by mask then give all orders, so an order costs no pass over documents.

A repeated text is told from the first by its SHA-256: the first is found by an aggregation on the digest, and rows are
joined with the firsts on digest and id together, so copies of one text spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import bounded_batches, trim

LETTERS = "ABCDE"
#: Number of orders of the five filters.
ORDERS = 120


@dataclass(frozen=True)
class Filters:
    """A: fewer words. B: a smaller share of distinct words, in per cent. C: a larger share of capitals among code points, in per cent. D: one of these bytes."""

    least_words: int = 200
    least_distinct: int = 50
    most_capitals: int = 2
    symbols: bytes = b"#$%&*|"


def text_counts(docs: DataFrame, symbols: bytes = Filters.symbols) -> DataFrame:
    """doc_id, source, n_words, n_distinct, n_capitals, n_symbols, n_points and the SHA-256 of each whole text.

    A null text counts as empty. Other columns are dropped.
    """
    bounded_batches(docs.sparkSession)
    kinds = np.zeros((3, 256), bool)
    kinds[0, ord("A") : ord("Z") + 1] = True
    kinds[1, list(symbols)] = True
    kinds[2] = (np.arange(256) & 0xC0) != 0x80  # not a continuation byte
    names = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_points"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_bytes(batch.column("text"))
            counts = scan(data, offsets, kinds)
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [batch.column("doc_id"), batch.column("source"), *[pa.array(c) for c in counts], pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", *names, "digest"])
            del data, view, batch
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, {', '.join(f'{n} long' for n in names)}, digest binary")


def scan(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Words, distinct words and bytes of each kind of each text."""
    n = len(offsets) - 1
    out = np.zeros((2 + len(kinds), n), np.int64)
    firsts = []
    for a, b, start, end, h in words.words(data, offsets):
        doc = np.searchsorted(offsets, start, "right") - 1
        out[0] += np.bincount(doc, minlength=n)
        own = words.distinct(data, doc, start, end, h)
        firsts.append((doc[own], start[own], end[own], h[own]))
        lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b)
        at = np.clip(offsets[lo : hi + 1], a, b) - a
        upto = np.zeros(b - a + 1, np.int64)
        for k, kind in enumerate(kinds):
            np.cumsum(kind[data[a:b]], out=upto[1:])
            out[2 + k, lo:hi] += np.diff(upto[at])
    if firsts:
        doc, start, end, h = (np.concatenate(x) for x in zip(*firsts, strict=True))
        own = slice(None) if len(firsts) == 1 else words.distinct(data, doc, start, end, h)
        out[1] = np.bincount(doc[own], minlength=n)
    return out


def filter_masks(docs: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """doc_id, part and mask: bit i is set if the document fails the i-th filter.

    part is the source, null as an empty string. A document fails E if a smaller doc_id has its text; a null doc_id is neither smaller nor
    larger than any, and rows that repeat an id are none the smaller for it.
    """
    c = text_counts(docs, filters.symbols)
    fails = [
        F.col("n_words") < filters.least_words,
        100 * F.col("n_distinct") < filters.least_distinct * F.col("n_words"),
        100 * F.col("n_capitals") > filters.most_capitals * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    bits = F.lit(0)
    for i, f in enumerate(fails):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    rows = c.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("own"), "digest")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("own") + F.when(later, 16).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """A row per part, order of the filters and step: what the step keeps and removes.

    kept: documents left after it. redundant: documents that fail its filter but were removed before. unique_fails: documents that fail its filter only.
    good_lost, toxic_lost: removed here, with a label that says so (one of the label's rows is enough). shapley: what the filter removes, summed
    over all orders. No documents: no rows.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    masks = filter_masks(docs, filters).join(marks, "doc_id", "left")
    tally = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    per = tally.groupBy("part").agg(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in ("n", "good", "toxic") for m in range(32)])
    table = {c: F.array(*[F.col(f"{c}{m}") for m in range(32)]) for c in ("n", "good", "toxic")}
    steps = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(LETTERS[i] for i in order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(1 << f).alias("bit")))
            before |= 1 << f
    per = per.select("part", *[a.alias(c) for c, a in table.items()])
    # parts are few or many, but each brings the same 600 rows
    wide = per.repartition("part").select("*", F.inline(F.array(*steps)))

    def summed(column: str, hit) -> F.Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(hit(m), F.element_at(column, m + 1)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails, gone = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~gone(m)
    # of a mask's k filters each comes first in 120 / k orders
    share = lambda m: F.when(fails(m), F.lit(ORDERS) / F.bit_count(m)).otherwise(0).cast("long")
    shapley = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.lit(0).cast("long"), lambda acc, m: acc + share(m) * F.element_at("n", m + 1))
    return wide.select(
        "part", "filter_order", "step", summed("n", lambda m: ~gone(m) & ~fails(m)).alias("kept"), summed("n", here).alias("removed"), summed("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        summed("n", lambda m: m == bit).alias("unique_fails"), summed("good", here).alias("good_lost"), summed("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole documents, in all 120 orders, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (SELECT part, d.doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t) AS c, regexp_matches(d.t, '[#$%&*|]') AS dd, coalesce(d.doc_id > first, false) AS e
  FROM d JOIN firsts ON d.t = firsts.t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * dd::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
orders AS (SELECT [p.f, q.f, r.f, s.f, u.f] AS o FROM f p, f q, f r, f s, f u WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
steps AS (SELECT list_aggregate(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), 'string_agg', '') AS filter_order, step::INT AS step, 1 << o[step] AS bit,
  coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM x CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
