"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed byte n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model is fitted to
them by dual coordinate descent; a logistic curve over the margins of documents left out gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, held_out, utf8_column

BITS = 18
ORDERS = (1, 2, 3, 4)
#: Bytes that are hashed at once.
PIECE = 1 << 20
_MIX = np.uint32(2654435761)


def indicators(text: bytes, flags: np.ndarray) -> np.ndarray:
    """Sorted buckets of all n-grams in a text. flags: 2 ** BITS false values, left so."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(raw), 1), PIECE):
        b = raw[at : at + PIECE + max(ORDERS) - 1].astype(np.uint32)
        g = np.zeros(len(b), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(b) < n:
                break
            g = (g[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
            if n in ORDERS:
                flags[((g + np.uint32(n * 40503)) * _MIX) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def fit_hinge(
    rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, bound: np.ndarray, unit: np.ndarray, epochs: int = 30, tol: float = 1e-2
) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM, by dual coordinate descent.

    rows: active features; values: a feature's value where active, times the row's `unit`; y: -1 or 1; bound: the upper
    limit of each row's multiplier. A step sets one multiplier to its optimum and moves the weights along its row.
    """
    w, bias = np.zeros(len(values)), 0.0
    x = [values[r] * u for r, u in zip(rows, unit, strict=True)]
    q = np.array([v @ v for v in x]) + 1.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(1)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], x[i]
            slope = y[i] * (w[r] @ v + bias) - 1.0
            free = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= bound[i] else slope
            worst = max(worst, abs(free))
            if abs(free) > 1e-12:
                new = min(max(alpha[i] - slope / q[i], 0.0), bound[i])
                step, alpha[i] = (new - alpha[i]) * y[i], new
                w[r] += step * v
                bias += step
        if worst < tol:
            break
    return w, bias


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps on the log loss with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(margins)), 1e-9)
    m = margins / scale
    a, b = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0) / scale, b


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: bytes, flags: np.ndarray) -> float:
        found = indicators(text, flags)
        m = self.slope * (float(self.weights[found].sum()) / math.sqrt(max(len(found), 1)) + self.bias) + self.shift
        return 1 / (1 + math.exp(-min(max(m, -700), 700)))


def train(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0, folds: int = 3) -> QualityModel:
    """Fits to active buckets per document. Rows have unit length by sqrt(features), so long texts weigh no more.

    Without both classes the score is the only class's share, smoothed.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 0.0, math.log(p / (1 - p)))

    def fit(at: np.ndarray) -> tuple[np.ndarray, float]:
        count = {1.0: np.full(1 << BITS, alpha), -1.0: np.full(1 << BITS, alpha)}
        for i in at:
            count[y[i]][rows[i]] += 1
        # log of the ratio of each class's share of its documents
        n1, n0 = (y[at] > 0).sum(), (y[at] < 0).sum()
        ratio = np.log(count[1.0] / (n1 + 2 * alpha)) - np.log(count[-1.0] / (n0 + 2 * alpha))
        unit = [1 / math.sqrt(max(len(rows[i]), 1)) for i in at]
        bound = np.array([cost * len(at) / (2 * (n1 if y[i] > 0 else n0)) for i in at])
        w, b = fit_hinge([rows[i] for i in at], ratio, y[at], bound, unit)
        return w * ratio, b

    every = np.arange(len(y))
    order = np.random.default_rng(5).permutation(len(y))
    margins = np.empty(len(y))
    for k in range(folds):
        test = order[k::folds]
        rest = np.setdiff1d(every, test)
        if abs(y[rest].sum()) == len(rest):
            margins[test] = 0.0
            continue
        w, b = fit(rest)
        margins[test] = [w[rows[i]].sum() / math.sqrt(max(len(rows[i]), 1)) + b for i in test]
    slope, shift = fit_curve(margins, y)
    w, b = fit(every)
    return QualityModel(w, b, slope, shift)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Active buckets and labels of the `most` labelled ids, not held out, with the smallest hashes.

    The ids are taken by a top-k, so what is broadcast to the documents is bounded by `most` rows, and so is what comes back: a row an id,
    of 4 bytes for each different n-gram bucket of its text (1 MB at most, a few KB for usual texts).
    """
    spark = docs.sparkSession
    ids = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label")).filter("lid IS NOT NULL AND label IS NOT NULL")
    chosen = ids.filter(~held_out(F.col("lid"))).orderBy(F.xxhash64("lid"), "lid", "label").limit(most)
    chosen = spark.createDataFrame([tuple(r) for r in chosen.collect()], "lid long, label int")
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for b in batches:
            found = [indicators(t, flags).astype("<i4").tobytes() for t in utf8_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("lid"), b.column("label"), pa.array(found, pa.binary())], ["lid", "label", "found"])

    met = rows.join(F.broadcast(chosen), F.col("d") == F.col("lid")).select("lid", "label", "text").mapInArrow(active, "lid long, label int, found binary")
    met = met.groupBy("lid", "label").agg(F.min("found").alias("found"))  # rows that repeat an id count once
    got = sorted((r.lid, r.label, bytes(r.found)) for r in met.collect())
    return [np.frombuffer(x[2], "<i4") for x in got], np.array([x[1] for x in got])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model of `label_col` from at most `most` labelled documents that are not held out."""
    bounded_batches(docs.sparkSession)
    return train(*labelled_sample(docs, labels, most, id_col, text_col, label_col))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is scored, whole; a null or empty text has the score of a text without n-grams. Null ids are not held
    out. Repeated rows have equal scores. Columns other than the two named are not read.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, m = np.zeros(1 << BITS, bool), held.value
        for b in batches:
            scores = np.array([m.score(t, flags) for t in utf8_column(b, "text")], np.float64)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
