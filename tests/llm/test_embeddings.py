"""Embedding links against brute force."""

import numpy as np

from loomseg.llm import embeddings

SF = "/root/testdata/sf0.001"


def _check(rows, vectors, threshold=0.9):
    ids = [i for i, _ in vectors]
    ok = [v is not None and len(v) > 0 and all(x is not None for x in v) and bool(np.isfinite(np.array(v, float)).all()) and any(v) for _, v in vectors]
    links = {}
    for i in range(len(ids)):
        links[i] = {j for j in range(len(ids)) if j != i and ok[i] and ok[j] and len(vectors[i][1]) == len(vectors[j][1]) and _cos(vectors[i][1], vectors[j][1]) >= threshold}
    want = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min(ids[j] for j in seen)
        want.append((ids[i], len(links[i]), c, ids[i] == c))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == sorted(want)


def _cos(a, b):
    a, b = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
    return a @ b / np.sqrt((a @ a) * (b @ b))


def test_op3_by_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    _check(embeddings.op3_embeddings(spark, SF).collect(), rows)


def test_groups_larger_than_a_chunk_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    rows = [(i, (centre + 0.35 * rng.standard_normal(8)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000 + i, rng.standard_normal(8).tolist()) for i in range(50)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] + [1.0] * 7), (3004, [None] + [1.0] * 7), (3005, [1e300] * 8), (3006, [1e-300] * 8), (3007, [2.0] * 3), (3008, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rid", "2 AS v")
    _check(embeddings.embedding_links(df, miss=1e-9).collect(), [(i, None if v is None else v) for i, v in rows])
    assert embeddings.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
