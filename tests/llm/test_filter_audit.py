"""Word borders, hashes and the interaction of filters, against plain Python."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from loomseg.llm import filter_audit, words
from loomseg.llm.filter_audit import audit, scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = np.zeros((3, 256), bool)
KINDS[0, 65:91] = True
KINDS[1, list(b"#$%&*|")] = True
KINDS[2] = (np.arange(256) & 0xC0) != 0x80


def _texts(seed=1):
    rng = random.Random(seed)
    alphabet = ["a", "B", "é", "𝔘", " ", "\t", "\n", "#", "|", " ", "\x0b", "\x85", "abcdefghij" * 3]
    out = ["", None, " ", "x", " \n\t", "A#", "one two", "two", "w " * 300, "same same", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 19])
def test_scan_equals_regular_expressions(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    texts = _texts()
    data, offsets = words.text_bytes(pa.array(texts)[0:])
    got = scan(data, offsets, KINDS)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        assert got[:, i].tolist() == [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)], repr(t)


def test_sliced_column():
    data, offsets = words.text_bytes(pa.array(["one", None, "two three", ""])[1:3])
    assert bytes(data) == b"two three" and offsets.tolist() == [0, 0, 9]


def test_equal_hashes_are_verified():
    data = np.frombuffer(b"aa bb aa cc bb" + b"long-word-1 long-word-2 long-word-1", np.uint8)
    starts = np.array([0, 3, 6, 9, 12, 14, 26, 38])
    ends = np.array([2, 5, 8, 11, 14, 25, 37, 49])
    kept = words.distinct(data, np.zeros(8, np.int64), starts, ends, np.zeros(8, np.uint64))
    assert sorted(bytes(data[starts[i] : ends[i]]) for i in kept) == [b"aa", b"bb", b"cc", b"long-word-1", b"long-word-2"]


def _brute(docs, labels):
    mask, first = {}, {}
    for doc_id, text, source in docs:
        t = text or ""
        if doc_id is not None:
            first[t] = min(first.get(t, doc_id), doc_id)
    rows = []
    for doc_id, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and first[t] < doc_id]
        good = any(d == doc_id and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc_id and x == 1 for d, _, x in labels if d is not None)
        rows.append((source or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        removed = {}
        for order in permutations(range(5)):
            for step, f in enumerate(order):
                one = dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"], 0)
                for p, fails, good, toxic in rows:
                    if p != part:
                        continue
                    gone = any(fails[g] for g in order[:step])
                    one["kept"] += not gone and not fails[f]
                    one["removed"] += fails[f] and not gone
                    one["redundant"] += fails[f] and gone
                    one["unique_fails"] += fails[f] and sum(fails) == 1
                    one["good_lost"] += fails[f] and not gone and good
                    one["toxic_lost"] += fails[f] and not gone and toxic
                removed[f] = removed.get(f, 0) + one["removed"]
                out[part, "".join("ABCDE"[i] for i in order), step + 1] = one
        for (p, order, step), one in out.items():
            if p == part:
                one["shapley"] = removed["ABCDE".index(order[step - 1])]
    return out


def test_audit_equals_every_order(spark):
    rng = random.Random(5)
    pool = ["w " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "short # text", "", None, " ".join(f"x{i}|" for i in range(220))]
    docs = [(rng.choice([None, *range(60)]), rng.choice(pool) if rng.random() < 0.7 else " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.randrange(300))), rng.choice(["s", "t", "", None])) for _ in range(120)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, source string, part string, mask int")
    got = audit(frame, spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()
    want = _brute(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == want[r.part, r.filter_order, r.step]


def test_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit(odd, labels).collect()
    assert len(rows) == 600 * len({r.part for r in rows}) and {r.part for r in rows} == {"", "a", "b"}
    assert audit(empty, labels).count() == 0


def test_a_text_of_many_blocks(spark):
    text = " ".join(f"word{i % 70_000}" for i in range(600_000)) + " " + "y" * (3 << 19)
    got = filter_audit.text_counts(spark.createDataFrame([(1, text, "a"), (2, text, "a")], "doc_id long, text string, source string")).collect()
    assert {(r.n_words, r.n_distinct, r.n_points) for r in got} == {(600_001, 70_001, len(text))}
