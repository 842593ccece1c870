"""Suffix arrays and the removal of repeats, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomseg.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"


def _brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    part = bytes(rng.choice(b"ab") for _ in range(300))
    b = np.frombuffer(part + bytes(rng.choice(b"abc") for _ in range(500)) + part + b"a" * 200, np.uint8)
    order = sd.suffix_array(b)
    raw = b.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    got = sd.common_prefixes(b, order, 64, lanes=7)
    assert (sd.common_prefixes(b, order, 64, lanes=500) == got).all()
    for k in range(1, len(order)):
        x, y = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert got[k] == min(n, 64)


def test_op7_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip((d.doc_id for d in docs), _brute([d.text for d in docs], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op7_suffix_dedup(spark, SF).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_hard_texts(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, long = para(60), para(300)
    texts = [para(40) + shared + para(40) for _ in range(6)] + [long, long[:700] + para(5) + long[700:], long[3:], "a" * 1500, "ab" * 700, "x" + "ab" * 300, None, "", shared[:150], shared + shared]
    texts += [long[:400] + str(i) + long[401 + i :] for i in range(12)]
    monkeypatch.setattr(sd, "SHARD", 4)
    monkeypatch.setattr(sd, "BLOCK", 900)
    sd._powers.cache_clear()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS th", "2 AS w")
    want = _brute([*texts, texts[0]], 160)
    got = {}
    for r in sd.remove_repeats(docs, 160).collect():
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == {i: {w} for i, w in enumerate(want[:-1])}
    rows = sd.remove_repeats(odd).collect()
    assert len(rows) == 8 and {r.n_removed for r in rows if r.doc_id == 5} == {150_000}
    assert sd.remove_repeats(empty).count() == 0


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of 51 words and more in several texts: every byte of one goes if it has 400 bytes, and none if it is shorter."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(3, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 52, 55, 60, 70, 90, 130)]
    passages += [p.encode()[:n].decode("utf-8", "ignore") for n in (399, 400, 401) for p in passages[-1:]]
    texts = [f"{rng.random()} {' '.join(word() for _ in range(20))} {p} {rng.random()}" for p in passages for _ in range(3)]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == _brute(texts, 400)
    for i, p in enumerate(p for p in passages for _ in range(3)):
        assert (got[i].n_removed >= len(p.encode())) == (got[i].n_removed > 0) == (len(p.encode()) + 2 >= 400)
