from __future__ import annotations

import random
import zlib

import numpy as np
from quire.llm import op4_packing as op
from quire.llm.catalogue import tokenizer

from .helpers import frame

PATH = tokenizer("byte_bpe_50k.json")


def texts() -> dict:
    rnd = random.Random(3)
    out = {i: " ".join(rnd.choice(["the", "Zeile", "é", "naïve", "42", "\n\n", "don't", "x" * 30]) for _ in range(rnd.choice([1, 50, 300, 900, 3000]))) for i in range(150)}
    return out | {500: None, 501: "", 502: "<|endoftext|> a   b\t\n", 503: "日本語 🙂 ﷽", 504: "a" * 20000}


def ids(tok, t) -> list[int]:
    return [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_and_sequences(spark):
    ts, tok = texts(), reference()
    got = op.pack(frame(spark, ts, parts=5), PATH, with_ids=True).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(ts)
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        want = ids(tok, ts[i])
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert [x for r in rows for x in r.ids] == want
        assert [r.start for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1])
        assert all(r.length == 1024 for r in rows[1:]) and 1 <= rows[0].length <= 1024
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rows in seqs.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    whole, _, fills = op.best_fit(np.array([r.length for r in got]))
    assert len(seqs) <= len(fills) * 1.01 + 2 and len(whole) == len(got)


def test_best_fit_is_decreasing_and_tight():
    where, offset, fills = op.best_fit(np.array([600, 500, 424, 524, 1024, 1]))
    assert sorted(fills.tolist()) == [1, 1024, 1024, 1024]
    assert offset[np.array([600, 500, 424, 524, 1024, 1]) == 600] == 0


def test_many_parts_merge_as_a_tree(spark):
    got = op.pack(frame(spark, {i: "word " * (i % 40) for i in range(400)}, parts=30), PATH).collect()
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 1024) + 1


def test_special_token_strings_are_as_tokenizers_has_them(spark):
    text = "hello <|endoftext|> world"
    (row,) = op.pack(frame(spark, {1: text}), PATH, with_ids=True).collect()
    assert row.ids == [*reference().encode(text, add_special_tokens=False).ids, 2] and 50256 in row.ids


def test_counts_pack_as_items_do():
    rnd = np.random.default_rng(5)
    for top, n in ((1024, 3000), (300, 500), (40, 2000), (1024, 1), (600, 700)):
        sizes = rnd.integers(1, top + 1, n)
        _, _, fills = op.best_fit(sizes)
        values, many = np.unique(sizes, return_counts=True)
        stretches = op.best_fit_counts(dict(zip(values.tolist(), many.tolist(), strict=True)))
        bins: dict = {}
        for size, number, first, each, offset in stretches:
            following = [t[1] for t in stretches if t[0] == size and t[1] > number]
            for k in range(min(following, default=int(many[values == size][0])) - number):
                bins.setdefault(first + k // each, []).append((offset + k % each * size, size))
        assert sum(map(len, bins.values())) == n
        assert len(bins) == len(fills)
        for held in bins.values():
            at = 0
            for offset, size in sorted(held):
                assert offset == at
                at += size
            assert at <= 1024
    # a billion items take no more steps than ten
    assert len(op.best_fit_counts({600: 10**9, 400: 10**9, 10: 10**9})) < 20


def test_many_parts_are_within_a_hundredth_of_global_best_fit(spark):
    rnd = random.Random(9)
    ts = {i: "word " * min(1500, int(rnd.lognormvariate(5, 1))) for i in range(3000)}
    got = op.pack(frame(spark, ts, parts=32), PATH).collect()
    _, _, fills = op.best_fit(np.array([r.length for r in got]))
    assert len({r.sequence_id for r in got}) <= len(fills) * 1.01
    # lengths that go together are in different partitions
    apart = {i: "word " * (598 if i < 500 else 422) for i in range(1000)}
    got = op.pack(frame(spark, apart, parts=1).repartitionByRange(16, "doc_id"), PATH).collect()
    assert len({r.sequence_id for r in got}) == 500


def test_odd_rows(spark):
    got = op.pack(frame(spark, [(1, "a"), (1, "a"), (None, None)]), PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 2), ("1", 2), ("None", 1)]
    assert op.pack(frame(spark, {}), PATH).count() == 0
