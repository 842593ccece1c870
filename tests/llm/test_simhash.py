"""SimHash links and connected components, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomseg.llm import simhash
from loomseg.llm.components import connected_components, forest

SF = "/root/testdata/sf0.001"


def _fp(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def _brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_op1_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = [d.doc_id for d in docs]
    fps = [_fp(d.text) for d in docs]
    root = _brute_components(fps)
    first = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect()}
    assert got == {d: (f"{f:016x}", first[r]) for d, f, r in zip(ids, fps, root, strict=True)}


@pytest.mark.parametrize(("n", "part"), [(1000, 64), (1000, 1), (simhash.MANY, 64)])
def test_dense_group_of_close_fingerprints(spark, monkeypatch, n, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 1500:
        x = base
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = np.array(sorted(fps), "<u8").view("<i8").tolist()
    links = simhash.near_links(spark.createDataFrame([(x, [x]) for x in signed], "id long, fp array<long>"), simhash.exact_index(n)).collect()
    a, b = (np.array([r[i] for r in links]) for i in (0, 1))
    assert all((int(x) ^ int(y)) & (1 << 64) - 1 for x, y in zip(a, b, strict=True))
    got = dict(zip(*(v.tolist() for v in forest(a, b)), strict=True))
    arr = np.array(signed).view("<u8")
    x, y = np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4)
    want = dict(zip(*(v.tolist() for v in forest(np.array(signed)[x], np.array(signed)[y])), strict=True))
    assert got == want


def test_odd_rows(spark, odd, empty):
    rows = simhash.simhash_components(odd.withColumn("fp", F.lit("clash"))).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[3] == by[None] == {1} and by[4] == {4} and by[5] == {5}
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.simhash_dedup(odd.withColumn("row", F.lit(1)))
    assert kept.columns[-1] == "row" and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    assert simhash.simhash_dedup(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(1, i) for i in range(500, 900)] + [(7, 7), (900, 901), (901, 900)]
    random.Random(1).shuffle(links)
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect())
    assert got == {i: 100 for i in range(100, 401)} | {i: 1 for i in [1, *range(500, 900)]} | {900: 900, 901: 900}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_loose_similarity(spark):
    rng = random.Random(2)
    docs, groups = [], []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 500))]
        for k in range(3):
            own = list(words)
            for _ in range(len(own) * k // 100):  # a changed word breaks five shingles
                own[rng.randrange(len(own))] = "x"
            docs.append((len(docs), " ".join(own)))
            groups.append(g)
    index = simhash.index_for(len(docs), 0.18, 0.01)
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string"), index, 5).collect()}
    want = {i: 3 * groups[i] for i in range(len(docs))}
    assert sum(got[i] != want[i] for i in want) <= 2 and all(groups[got[i]] == groups[i] for i in want)


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_dedup_links_every_pair_from_the_similarity_on_and_no_other(spark):
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    docs = []
    for n in (9, 14, 24, 44, 104, 304, 1004):
        for part in (0.5, 0.6, 0.7, 0.74, 0.77, 0.79, 0.8, 0.81, 0.85, 0.95):
            base, m = new(n), n - 4
            shared = round(m * 2 * part / (1 + part))  # shingles in both, of m each
            docs += [base, base[: shared + 4] + new(m - shared)]
            docs.append(base[:4] + base[4:] * 3 if n == 104 else new(n))
    hub = new(200)  # a large group whose members are similar to its centre only
    for _ in range(150):
        k = rng.randrange(10, 170)
        docs.append(hub[:k] + new(14) + hub[k + 14 :])
    docs.append(hub)
    texts = [" ".join(w) for w in docs]
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if find(i) == i}
    assert len(want) < len(texts) - 150
    got = {r.doc_id for r in simhash.simhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_what_is_linked_does_not_follow_the_number_of_rows():
    sizes = (1, 1000, 2**18, 300_000, 10**6, 5 * 10**6, 10**9)
    for make in (lambda n: simhash.index_for(n, 0.18, 0.03), simhash.similar_index):
        assert len({(i.compared, i.radius) for i in map(make, sizes)}) == 1
        assert all(max(w for w, _, _ in make(n).segments) < make(n).words for n in sizes)
    text = " ".join(f"w{i % 37}" for i in range(300)).encode()
    few, many = (simhash.fingerprint(text, 5, words=simhash.similar_index(n).words, distinct=True) for n in (1000, 5 * 10**6))
    assert len(few) < len(many) and (few == many[: len(few)]).all()


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    """A forced clash of the first hash: different texts stay, copies go."""
    monkeypatch.setattr(simhash, "_identity", lambda text: (F.length(text).cast("long"), F.xxhash64(text)))
    words = [f"w{i:04d}" for i in range(400)]
    texts = [" ".join(words[k * 40 : k * 40 + 40]) for k in range(10)]  # all of one length
    docs = [(i, t) for i, t in enumerate(texts)] + [(20 + i, t) for i, t in enumerate(texts)] + [(40, texts[0][:-5] + "w9999")]
    kept = simhash.simhash_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(10))


def _rows_of_joins(df):
    """Runs df; the rows that each of its joins made."""
    df.write.format("noop").mode("overwrite").save()
    run = df._jdf.queryExecution()
    rows = df.collect()
    out, todo = [], [run.executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        todo += [p.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in name:
            out.append(p.metrics().apply("numOutputRows").value())
    return rows, out


def test_rows_made_for_a_dense_group_follow_its_size(spark, monkeypatch):
    """No join gives a row for each meeting of a large group's members with its entries: there are no more than members and visits."""
    monkeypatch.setattr(simhash, "ENTRY", 4)
    rng, base, n = random.Random(8), random.Random(9).getrandbits(64), 1000
    fps = {base}
    while len(fps) < n:
        fps.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = np.array(sorted(fps), "<u8").view("<i8").tolist()
    links, joins = _rows_of_joins(simhash.near_links(spark.createDataFrame([(x, [x]) for x in signed], "id long, fp array<long>")))
    assert len(forest(*np.array([tuple(r) for r in links]).T)[0]) == n - 1
    assert max(joins, default=0) <= n * (3 + 64)


@pytest.mark.parametrize("limits", [(1 << 16, 1 << 11, 1 << 16), (50, 10, 30), (50, 1 << 11, 1 << 16)])
@pytest.mark.parametrize("apart", [False, True])
def test_rows_of_a_key_meet_whatever_the_batches(monkeypatch, limits, apart):
    for name, v in zip(("PAIRS", "LARGE", "WAITING"), limits, strict=True):
        monkeypatch.setattr(simhash, name, v)
    rng = random.Random(sum(limits))
    rows = []
    for key, (members, visitors) in enumerate([(1, 0), (0, 5), (1, 1), (7, 3), (60, 0), (40, 150), (3, 200), (1, 1), (90, 90)]):
        for part in (0, 1):
            bases = [rng.getrandbits(64) for _ in range(1 + key % 4)]
            for k in range(members + visitors):
                fp = rng.choice(bases) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
                rows.append({"id": rng.randrange(-(2**62), 2**62), "c": rng.randrange(6), "f0": fp - (fp >> 63 << 64), "f1": -(1 << 63), "key": key, "part": part, "own": k < members})
    want = [(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if x["own"] and (x["key"], x["part"]) == (y["key"], y["part"])]
    want = [(x["id"], y["id"]) for x, y in want if ((x["f0"] ^ y["f0"]) & (1 << 64) - 1).bit_count() <= 4 and (not apart or x["c"] != y["c"])]
    names = [n for n in rows[0] if apart or n != "c"]
    for size in (1, 7, 64, len(rows)):
        table = pa.table({n: [r[n] for r in rows] for n in names})
        got = [b.to_pydict() for b in simhash._meet(4)(iter(table.to_batches(max_chunksize=size)))]
        a, b = (np.array([v for g in got for v in g[n]], np.int64) for n in "ab")
        assert [v.tolist() for v in forest(a, b)] == [v.tolist() for v in forest(*np.array(want).T)]
