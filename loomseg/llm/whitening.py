"""Whitening of embeddings: a covariance made of tiles, its eigenvectors, and the projection of every vector.

Entries become integers, so the mean and each vector's deviation are exact. Dimension pairs are cut into tiles. Rows are cut into
row-blocks of bounded size; each sends its column blocks, keyed by the row-block, and the task that gets them multiplies the
blocks of every tile pair and adds to its own tiles, so a task sends each tile once, whatever its number of rows. Tiles of
all tasks are added in two rounds. The driver assembles them: its memory follows the dimensions, at most MOST_DIMS, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, trim

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Larger entries count as this, in x's units: sums stay exact.
MOST = 1 << 40
MOST_DIMS = 4096
#: Dimensions of a tile, and bytes of a row-block.
TILE, ROW_BLOCK = 256, 4 << 20
#: Tiles are added under so many keys each before the last round.
SALTS = 16
#: Of the largest eigenvalue: what lies below counts as no variance.
LEAST = 1e-12


@dataclass
class Whitening:
    """What a fit yields. components: a row each, of unit length, by falling variance; the largest entry of each is positive."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace > 0 else np.zeros(len(self.variances))


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors (of `dims` finite entries), and their entries as integers less SHIFT."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    bad = ~np.isfinite(np.where(values.is_valid().to_numpy(zero_copy_only=False), values.fill_null(0.0).to_numpy(), np.nan))
    upto = np.concatenate([[0], np.cumsum(bad)])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dims) & (upto[offsets[1:]] == upto[offsets[:-1]])
    rows = np.flatnonzero(ok)
    c = values.fill_null(0.0).to_numpy()[offsets[rows][:, None] + np.arange(dims)]
    with np.errstate(over="ignore"):
        return rows, np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64)


def usable(vector) -> F.Column:
    """True for a vector without null or non-finite entries."""
    v = vector.cast("array<double>")
    return F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def dimensions(vectors: DataFrame, vector: str) -> int:
    """The commonest length of usable vectors, the larger of equally common ones; 0 if there is none."""
    top = vectors.where(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0].d if top else 0


def _sums(vectors: DataFrame, vector: str, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            rows, x = integers(batch.column(0), dims)
            n += len(rows)
            for a in range(0, len(rows), 1 << 20):
                sums = [s + t for s, t in zip(sums, x[a : a + (1 << 20)].sum(axis=0).tolist(), strict=True)]
        if n:
            values = [Decimal(v) for v in [n, *sums]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1) - 1, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["d", "s"])

    got = vectors.select(vector).mapInArrow(run, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    at = {r.d: int(r.s) for r in got}
    return at.get(-1, 0), [at.get(d, 0) + SHIFT * at.get(-1, 0) for d in range(dims)]


def column_blocks(vectors: DataFrame, vector: str, dims: int, centre: np.ndarray) -> DataFrame:
    """row_block, col_block, n, payload: the rows' integers less the centre, a tile's columns at a time."""
    per = max(1, ROW_BLOCK // (8 * dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, x = integers(batch.column(0), dims)
            for a in range(0, len(x), per):
                part = x[a : a + per] - centre
                kind = np.int32 if np.abs(part).max(initial=0) < 1 << 31 else np.int64
                cut = [np.ascontiguousarray(part[:, c : c + TILE].astype(kind)).tobytes() for c in range(0, dims, TILE)]
                k = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([first + at] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([len(part)] * k, pa.int32()), pa.array(cut, pa.binary())], ["row_block", "col_block", "n", "payload"])
                at += 1

    return vectors.select(vector).mapInArrow(run, "row_block long, col_block int, n int, payload binary")


_TILES = "i int, j int, tile binary"


def _tile_rows(tiles: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (i, j), t in tiles.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["i", "j", "tile"])


def tile_products(blocks: DataFrame, dims: int, rest: np.ndarray) -> DataFrame:
    """i, j, tile: sums over a task's row-blocks of the products of their column blocks, each less the rest of its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        own, held = None, {}

        def multiply():
            for i, a in held.items():
                for j, b in held.items():
                    if i <= j:
                        product = a.T @ b
                        tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product

        for batch in batches:
            for row, col, n, payload in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if row != own:
                    multiply()
                    own, held = row, {}
                width = min(TILE, dims - col * TILE)
                kind = np.int32 if len(payload) == 4 * n * width else np.int64
                held[col] = np.frombuffer(payload, kind).reshape(n, width) - rest[col * TILE : col * TILE + width]
        multiply()
        yield from _tile_rows(tiles)
        trim()

    return blocks.repartition("row_block").sortWithinPartitions("row_block").mapInArrow(run, _TILES)


def added_tiles(tiles: DataFrame) -> DataFrame:
    """One tile for each (i, j, salt), added as they come: a task holds one sum and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for batch in batches:
            for i, j, salt, tile in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                t = np.frombuffer(tile, np.float64)
                if (i, j, salt) != own:
                    if own is not None:
                        yield from _tile_rows({own[:2]: total})
                    own, total = (i, j, salt), t.copy()
                else:
                    total += t
        if own is not None:
            yield from _tile_rows({own[:2]: total})

    return tiles.repartition("i", "j", "salt").sortWithinPartitions("i", "j", "salt").mapInArrow(run, _TILES)


def fit_whitening(vectors: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Mean and principal components of all usable vectors: x = floor(1024 c) + 100000 of each entry c.

    Vectors that are null or hold null or non-finite entries are left out, as are those of another length than the commonest one. None if there
    is none left, or only empty ones. Entries beyond 2 ** 30 count as that. More than MOST_DIMS dimensions are an error.
    """
    bounded_batches(vectors.sparkSession, ROW_BLOCK)
    dims = dimensions(vectors, vector)
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions; at most {MOST_DIMS}")
    if not dims:
        return None
    n, sums = _sums(vectors, vector, dims)
    low = [s - SHIFT * n for s in sums]
    centre = np.array([s // n for s in low], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(low, centre, strict=True)])
    products = tile_products(column_blocks(vectors, vector, dims, centre), dims, rest)
    once = added_tiles(products.withColumn("salt", F.spark_partition_id() % SALTS).select("i", "j", "salt", "tile"))
    total = added_tiles(once.select("i", "j", F.lit(0).alias("salt"), "tile"))
    cov = np.zeros((dims, dims))
    for r in total.toLocalIterator():
        a, b = r.i * TILE, r.j * TILE
        t = np.frombuffer(r.tile, np.float64).reshape(min(TILE, dims - a), -1) / n
        cov[a : a + t.shape[0], b : b + t.shape[1]] = t
        cov[b : b + t.shape[1], a : a + t.shape[0]] = t.T
    e, v = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-e, kind="stable")
    v = v[:, order].T
    sign = np.sign(v[np.arange(dims), np.abs(v).argmax(axis=1)])
    return Whitening(n, sums, v * sign[:, None], np.maximum(e[order], 0), float(np.trace(cov)))


def _deviations(x: np.ndarray, n: int, low: list[int]) -> list[int | None]:
    """Exact sums of (n x - S) ** 2; None beyond a long."""
    off = np.abs(x - np.array([s / n for s in low])).max(initial=0) * n
    if n * float(np.abs(x).max(initial=0)) < 2.0**61 and off * off * x.shape[1] < 2.0**62:
        d = n * x - np.array(low, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(r, low, strict=True)) for r in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def identity_error(vectors: DataFrame, fit: Whitening, most: int, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components that have variance."""
    k, project = _projection(fit, most)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, x = integers(batch.column(0), len(fit.sums))
            w = project(x)[:, :k]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    # entries are centred by the fit's mean before they are multiplied; what rounding leaves of a mean goes here
    got = {r["at"]: r.v for r in vectors.select(vector).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    total = np.array([got[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / fit.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _projection(fit: Whitening, most: int):
    """The number of components with variance among the first `most`, and a function from integers to whitened values."""
    k = int((fit.variances[:most] > LEAST * fit.variances[0]).sum())
    basis = (fit.components[:k] / np.sqrt(fit.variances[:k])[:, None]).T
    low = [s - SHIFT * fit.n for s in fit.sums]
    centre = np.array([s // fit.n for s in low], np.int64)
    rest = np.array([(s - fit.n * int(c)) / fit.n for s, c in zip(low, centre, strict=True)])
    width = min(most, len(fit.sums))

    def project(x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), width), np.nan)
        out[:, :k] = ((x - centre) - rest) @ basis
        return out

    return k, project


def whiten(vectors: DataFrame, fit: Whitening | None, most: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component up to `most`: key, component (from 1), n, deviation, whitened, explained, identity_error.

    deviation is the exact sum of (n x - S) ** 2, null beyond a long. A component without variance has whitened null. Rows that repeat are
    kept; without usable vectors there are no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, ROW_BLOCK)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return spark.createDataFrame([], schema)
    error, dims = identity_error(vectors, fit, most, vector), len(fit.sums)
    _, project = _projection(fit, most)
    low, width = [s - SHIFT * fit.n for s in fit.sums], min(most, dims)
    explained, n, names = fit.explained[:width], fit.n, [f.split(" ")[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), dims)
            m, w = len(rows), project(x).ravel()
            deviation = _deviations(x, n, low)
            columns = [
                batch.column(0).take(pa.array(np.repeat(rows, width))), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, n, np.int64)),
                pa.array([d for d in deviation for _ in range(width)], pa.int64()), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    return vectors.select(key, vector).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit_whitening(vectors), 8)
