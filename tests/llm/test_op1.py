from __future__ import annotations

from quire.llm import op1_minhash as op

from .helpers import closed, frame, near_texts, shingles


def brute(texts: dict, k: int, percent: int) -> dict:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = list(texts)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = closed(ids, links)
    return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


def found(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_brute_force(spark):
    texts = near_texts()
    assert found(op.near_duplicates(frame(spark, texts), shingle_words=2)) == brute(texts, 2, 80)


def test_five_words(spark):
    texts = {i: t for i, t in near_texts(2).items() if i < 110}
    assert found(op.near_duplicates(frame(spark, texts), shingle_words=5)) == brute(texts, 5, 80)


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "A b\nc"), (3, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(frame(spark, rows), shingle_words=2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (None, 0, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert op.near_duplicates(frame(spark, {})).count() == 0


def test_signature_agreement_follows_similarity():
    import numpy as np

    rnd = np.random.default_rng(1)
    x = np.unique(rnd.integers(0, 2**63, 1000, dtype=np.uint64))
    y = np.unique(np.concatenate((x[:889], rnd.integers(0, 2**63, 111, dtype=np.uint64))))  # similarity 0.8
    same = [(op.signature(x ^ np.uint64(s)) == op.signature(y ^ np.uint64(s))).mean() for s in range(200)]
    assert 0.75 < np.mean(same) < 0.85
    assert min(same) * op.COORDINATES >= op.match_of(80)


def test_match_follows_the_threshold(spark):
    assert op.match_of(80) == 35 and op.match_of(100) == op.COORDINATES
    texts = near_texts(5)
    assert found(op.near_duplicates(frame(spark, texts), shingle_words=2, percent=60)) == brute(texts, 2, 60)


def test_ids_that_repeat_with_other_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    rows = [(1, base), (1, "something else of its own altogether"), (2, near), (2, "and again another text under two"), (3, near.replace("w50", "more"))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op.near_duplicates(frame(spark, rows), shingle_words=2).collect())
    assert {c for i, n, c in got if n > 40} == {1}


def test_a_key_of_many_texts_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 4)
    texts = near_texts(6)
    assert found(op.near_duplicates(frame(spark, texts), shingle_words=2)) == brute(texts, 2, 80)
