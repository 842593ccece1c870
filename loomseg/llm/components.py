"""Connected components of links between ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, stored

#: Links that one call of the local contraction takes: bounds a worker's memory.
BLOCK = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reached) with the same components as the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while (root != (up := root[root])).any():
            root = up
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for i in range(0, len(x), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in forest(x[i : i + BLOCK], y[i : i + BLOCK])], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a long, b long); component: the smallest node reachable.

    Links with a null end and self-links are ignored; repeated links and either direction are fine; no links, no rows.
    Links are first contracted in bounded blocks where they lie. A round then joins each node's
    smallest neighbour, from a table of its own, so that a hub's rows can be split over tasks. Every round is written to
    the shared folder, and the one before it is removed then; rounds end when the set of links stays the same.
    """
    e = stored(links.toDF("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "links")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("b", "a"))
        least = stored(both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("m")), "least")
        large = stored(both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lesser = stored(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        joined = large.join(lesser, F.col("a") == F.col("n"))
        pairs = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
        last, e = e, stored(pairs.select("p.*").filter("a <> b").distinct(), "links")
        before, mark = mark, _mark(e)
        release(last, least, large, lesser)
        if mark == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)
