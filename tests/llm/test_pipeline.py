"""The pipeline's stages against brute force on the smallest documents."""

from collections import Counter

import pytest

import corpus_pipeline
from loomseg.llm import mixing, token_store

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _bare(text):
    return [w for w in (x.strip(".,!?;:|*#%&$\"'()").lower() for x in text.split()) if w]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES[:4]:
        docs = f(spark, docs, SF).persist()
        assert docs.columns == corpus_pipeline.COLUMNS
        out.append(docs)
    return [[(r.doc_id, r.text) for r in d.collect()] for d in out], docs


def test_language_stage_keeps_clean_documents(stages):
    (before, after, *_), _ = stages
    gone = set(before) - set(after)
    assert set(after) <= set(before) and len(gone) <= 0.03 * len(before)
    assert all(any(c.isalpha() for c in t) for _, t in after)


def test_near_dedup(stages):
    (_, before, after, *_), _ = stages
    kept, sh = dict(after), {i: _shingles(t) for i, t in before}
    ids = sorted(sh)
    j = lambda a, b: len(sh[a] & sh[b]) / len(sh[a] | sh[b])
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sh[a] & sh[b] and j(a, b) >= 0.8]
    both = [(a, b) for a, b in close if a in kept and b in kept]
    assert close and len(both) <= 0.1 * len(close)
    alone = [a for a in ids if all(a == b or not sh[a] & sh[b] or j(a, b) < 0.4 for b in ids)]
    assert len(alone) > 20 and all(a in kept for a in alone)
    assert len({t for _, t in after}) == len(after)


def test_decontamination(spark, stages):
    (_, _, before, after, _), _ = stages
    grams = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = _bare(r.text)
        grams.append({tuple(w[i : i + 8]) for i in range(len(w) - 7)})
    for d, t in before:
        w = _bare(t)
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        assert any(len(own & g) >= 0.3 * len(g) for g in grams) == ((d, t) not in after)


def test_mixing_and_tokens(spark, stages):
    (_, _, _, before, after), docs = stages
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(spark.createDataFrame([(d, t, None) for d, t in before], "doc_id long, text string, source string")).collect()}
    assert set(plan) == {d for d, _ in before} and set(after) <= set(before)
    rows = corpus_pipeline.tokens(spark, docs, SF).collect()
    tok = token_store.encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    n = {d: len(tok.encode([t.encode()])[0]) // 2 + 1 for d, t in after}
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in after) and all(r.n_tokens == n[r.doc_id] for r in rows)


def test_run_is_the_stages(spark, stages):
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter(d for d, _ in stages[0][4])


def test_near_dedup_is_exact(stages):
    (_, before, after, *_), _ = stages
    kept, sh = dict(after), {i: _shingles(t) for i, t in before}
    ids = sorted(sh)
    close = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sh[a] & sh[b] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])}
    assert close and not [p for p in close if p[0] in kept and p[1] in kept]
    partners = {x for p in close for x in p}
    assert all(i in kept for i in ids if i not in partners)
