"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

A table's bucket is dealt to chunks of a bounded number of vectors. Vectors are compared chunk against chunk, in
blocks; a block emits each vector's number of new links and a spanning forest, never the pairs. A pair that
several tables meet is counted in the first of them only, which the signs themselves tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import stored

#: Vectors in a chunk, about.
CHUNK = 256


def tables_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets of about a hundred vectors, and so many tables that a pair at the threshold is missed with probability `miss`."""
    bits = min(24, max(4, round(math.log2(max(n, 2))) - 7))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def sign_codes(v: np.ndarray, p: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    s = (v @ p > 0).reshape(len(v), -1, bits)
    return s @ (1 << np.arange(bits, dtype=np.int64))


def _unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    raw = raw / big
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _usable(vectors) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        a = None if v is None or any(x is None for x in v) else np.array(v, np.float64)
        out.append(a if a is not None and a.size and np.isfinite(a).all() and a.any() else None)
    return out


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold; those within rounding of it are decided by exact sums."""
    s = a @ b.T
    i, j = np.nonzero(s >= threshold - 1e-12)
    edge = np.nonzero(s[i, j] < threshold + 1e-12)[0]
    drop = [k for k in edge if math.fsum(a[i[k]] * b[j[k]]) / math.sqrt(math.fsum(a[i[k]] ** 2) * math.fsum(b[j[k]] ** 2)) < threshold]
    return np.delete(i, drop), np.delete(j, drop)


def link_blocks(vectors: DataFrame, dtype: str, threshold: float, miss: float, seed: int) -> DataFrame:
    """(kind, a, b) from distinct vectors (rid long, many long, v binary of dtype numbers): kind 0: a has b more links; kind 1: a and b are connected."""
    n = vectors.count()
    bits, tables = tables_for(n, threshold, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x, dtype).astype(np.float64) for x in b.column("v").to_pylist()]
            codes: list = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                for i, c in zip(at, sign_codes(_unit(np.stack([rows[i] for i in at])), planes(dim, bits, tables, seed), bits), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("many"), b.column("v"), pa.array(codes, pa.list_(pa.int64()))], ["rid", "many", "v", "codes"])

    rows = vectors.mapInArrow(hashed, "rid long, many long, v binary, codes array<long>")
    rows = rows.select("rid", "many", "v", F.octet_length("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    # fuller buckets are dealt to chunks by a hash of the id; how full they are is counted on keys alone
    key = ["t", "code", "dim"]
    full = stored(rows.groupBy(*key).agg(F.count("*").alias("n")).filter(f"n > {CHUNK}").select(*[F.col(k).alias(f"f_{k}") for k in key], F.ceil(F.col("n") / CHUNK).alias("chunks")), "full")
    met = rows.join(full, [F.col(k) == F.col(f"f_{k}") for k in key], "left")
    met = met.withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.col("chunks"))))
    entry = F.struct("rid", "many", "v")
    chunks = met.groupBy(*key, "chunk").agg(F.collect_list(entry).alias("x")).filter("size(x) > 1")
    # only vectors of full buckets move again, to meet their bucket's other chunks
    many = met.filter("chunks IS NOT NULL").groupBy(*key, "chunk").agg(F.collect_list(entry).alias("x"))
    other = many.select(*key, F.col("chunk").alias("chunk_b"), F.col("x").alias("y"))
    pairs = many.join(other, key).filter("chunk < chunk_b").select("t", "dim", "x", "y")
    blocks = chunks.select("t", "dim", "x", F.lit(None).cast(chunks.schema["x"].dataType).alias("y")).union(pairs)

    def part(col, k):
        x = col[k]
        if x is None:
            return None
        v = np.frombuffer(b"".join(e["v"] for e in x), dtype).reshape(len(x), -1).astype(np.float64)
        return np.array([e["rid"] for e in x], np.int64), np.array([e["many"] for e in x], np.int64), _unit(v)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            kinds, left, right = [], [], []
            for r in range(batch.num_rows):
                one = batch.slice(r, 1).to_pydict()
                t, (ra, ma, a), second = one["t"][0], part(one["x"], 0), part(one["y"], 0)
                rb, mb, b = second or (ra, ma, a)
                i, j = _close(a, b, threshold)
                if second is None:
                    i, j = i[i < j], j[i < j]
                if t and len(i):
                    p = known.setdefault(a.shape[1], planes(a.shape[1], bits, tables, seed))[:, : t * bits]
                    ca = sign_codes(a, p, bits)
                    cb = ca if second is None else sign_codes(b, p, bits)
                    new = np.concatenate([~(ca[i[k : k + 20000]] == cb[j[k : k + 20000]]).any(axis=1) for k in range(0, len(i), 20000)])
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                ids = np.concatenate([ra[i], rb[j]])
                nodes, at = np.unique(ids, return_inverse=True)
                kinds.append(np.zeros(len(nodes), np.int32))
                left.append(nodes)
                right.append(np.bincount(at, np.concatenate([mb[j], ma[i]])).astype(np.int64))
                x, y = forest(ra[i], rb[j])
                kinds.append(np.ones(len(x), np.int32))
                left.append(x)
                right.append(y)
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kinds, left, right)], ["kind", "a", "b"])

    return blocks.mapInArrow(compare, "kind int, a long, b long")


def embedding_links(
    vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-4, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept (it is its component's smallest id).

    Vectors with the same components are one node that remembers how many they are; they link with each
    other. Null, empty or zero vectors and those with null or non-finite components link with nothing.
    Vectors of different lengths never link. A null id keeps its row (component null unless linked). Repeated ids are
    vectors of their own. A pair at the threshold is missed with probability `miss`, a closer one far less often.
    """

    dtype = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if a is None else (a + 0.0).astype(dtype).tobytes() for a in _usable(b.column("v").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(got, pa.binary())], ["vec_id", "v"])

    rows = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(packed, "vec_id long, v binary").withColumn("rid", F.xxhash64("v", F.octet_length("v"))), "vectors")
    usable = rows.filter("v IS NOT NULL")
    # rid: 64-bit hash of the vector; the smallest id of each copy group names it afterwards
    nodes = stored(usable.groupBy("rid", "v").agg(F.count("*").alias("many"), F.min("vec_id").alias("first")), "nodes")
    found = stored(link_blocks(nodes.select("rid", "many", "v"), dtype, threshold, miss, seed), "found")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("lid")).agg(F.sum("b").alias("links"))
    comps = stored(connected_components(found.filter("kind = 1").select("a", "b")), "components")
    placed = nodes.select("rid", "many", "first").join(comps, F.col("rid") == F.col("node"), "left").join(stored(links, "links"), F.col("rid") == F.col("lid"), "left")
    placed = stored(placed.select("rid", "first", F.coalesce("component", "rid").alias("c"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "placed")
    least = stored(placed.groupBy(F.col("c").alias("k")).agg(F.min("first").alias("least")), "least")
    named = stored(placed.join(least, F.col("c") == F.col("k")).select(F.col("rid").alias("node"), "n_links", "least"), "named")
    linked = usable.select("vec_id", "rid").join(named, F.col("rid") == F.col("node")).select("vec_id", "n_links", F.col("least").alias("component_id"))
    alone = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
