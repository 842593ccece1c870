"""Word windows that smaller documents have too, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomseg.llm import substring_dedup as sd
from loomseg.llm import words
from loomseg.llm.substring_dedup import Automaton, remove_known


def _brute(docs, length):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - length + 1):
                k = b" ".join(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[b" ".join(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def _corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "𝔘", "x" * 50]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [text(k) for k in (30, 49, 50, 51, 70, 200, 120)]
    line, copies = text(40), text(400)
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += [text(rng.randrange(60)), rng.choice(passages), line if rng.random() < 0.5 else ""]
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    docs += [(n + i, copies) for i in range(20)] + [(n + 20, "a " * 300), (n + 21, "a\n" * 200), (n + 22, "a b " * 150)]
    docs += [(None, copies), (None, None), (500, None), (501, ""), (502, " \n"), (3, copies), (7, docs[7][1]), (7, docs[9][1])]
    return docs


@pytest.mark.parametrize("length,shard,segment,run", [(50, 40_000, 1 << 17, 256), (50, 300, 64, 16), (32, 2000, 1 << 17, 256)])
def test_equals_brute_force(spark, monkeypatch, length, shard, segment, run):
    monkeypatch.setattr(sd, "SHARD_WORDS", shard)
    monkeypatch.setattr(sd, "FULL", shard)
    monkeypatch.setattr(sd, "SEGMENT", segment)
    monkeypatch.setattr(sd, "RUN", run)
    docs = _corpus(length + shard)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, key string, n int").repartition(3)
    got = remove_known(frame, length).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _brute(docs, length)
    for r in got:
        assert r.n_removed == sum(s.e - s.s for s in r.spans) and r.n_spans == len(r.spans)
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_known(docs).collect())
    assert got == _brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)


def test_odd_and_empty(spark, odd, empty):
    rows = remove_known(odd).collect()
    assert len(rows) == 8 and sum(r.n_removed for r in rows) == 0
    assert remove_known(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rng = random.Random(seed)
    bodies = [b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    numbers = [rng.randrange(100) for _ in bodies]
    one = Automaton(bodies, numbers, 4)
    for text in [*bodies, b" ".join(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(200))]:
        w = text.split(b" ")
        want = []
        for i in range(len(w) - 3):
            window = b" " + b" ".join(w[i : i + 4]) + b" "
            want.append(min((k for b, k in zip(bodies, numbers) if window in b" " + b + b" "), default=np.iinfo(np.int64).max))
        assert one.smallest(text).tolist() == want


@pytest.mark.parametrize("block", [3, 50, 1 << 19])
def test_runs_cover_every_window_once(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(sd, "SEGMENT", 70)
    rng = random.Random(2)
    texts = ["", None, " ".join(rng.choice("abcdefgh") for _ in range(500)), "x " * 31, "y " * 32, "", "z " * 400, " "]
    seen = {}
    for doc, key, first, size, a, b in sd.runs(pa.array(texts), 32):
        for d, k, f, n in zip(doc.tolist(), key.tolist(), first.tolist(), size.tolist()):
            for i in range(f, f + n):
                assert (d, i) not in seen
                seen[d, i] = k
    assert set(seen) == {(d, i) for d, t in enumerate(texts) for i in range(len((t or "").split()) - 31)}
    by = {}
    for (d, i), k in seen.items():
        by.setdefault(tuple((texts[d] or "").split()[i : i + 32]), set()).add(k)
    assert all(len(k) == 1 for k in by.values())
