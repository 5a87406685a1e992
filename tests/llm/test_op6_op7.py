from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from quire.llm import op6_licenses as lic
from quire.llm import op7_pieces as sp
from quire.llm.catalogue import tokenizer

from .helpers import frame

PATH = tokenizer("piece_bpe_32k.model")


def brute(text) -> dict:
    w = [x for x in lic.template_words(text or "") if x]
    sh = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, t in lic.NOTICES.items():
        ts = set(lic.template_shingles(t))
        size = lic.window_size(len(ts))
        hits = [(len(ts & set(sh[s : s + size])), -s) for s in range(0, len(sh), size // 2)]
        hits = [h for h in hits if h[0] * 100 >= 80 * len(ts)]
        if hits:
            out[name] = (max(hits)[0], len(ts), -max(hits)[1], len(hits))
    return out


def test_licenses_against_brute_force(spark):
    rnd = random.Random(8)
    filler = ["lorem", "ipsum", "license", "the", "under", "software"]
    texts = {}
    for i in range(120):
        w = [rnd.choice(filler) for _ in range(rnd.randrange(0, 120))]
        notice = rnd.choice(list(lic.NOTICES.values())).split()
        if rnd.random() < 0.4:
            notice[rnd.randrange(len(notice))] = "CHANGED"
        at = rnd.randrange(len(w) + 1)
        texts[i] = " ".join(w[:at] + notice + w[at:]) if i % 4 else " ".join(w)
    texts |= {500: None, 501: "", 502: "four words only here", 503: "x " * 50_000 + "RELEASED\tunder the MIT\nLicense."}
    got: dict = {}
    for r in lic.find_licenses(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.matched, r.shingles, r.start_word, r.n_windows)
    assert got == {i: b for i, t in texts.items() if (b := brute(t))}


def test_licenses_odd_tables(spark):
    assert lic.find_licenses(frame(spark, {})).count() == 0
    assert lic.find_licenses(frame(spark, [(1, "Released under the MIT License.")] * 2 + [(None, "Released under the MIT License.")])).count() == 3
    assert lic.find_licenses(frame(spark, {1: "Released under the MIT License."}), {}).count() == 0


def test_no_short_notice_is_lost(spark):
    docs = spark.range(60_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("Released under the MIT License."), *(F.concat(F.lit(" w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(10_000_019))) for j in range(7))).alias("text"))
    got = lic.find_licenses(docs).groupBy("license", "matched", "shingles", "start_word").agg(F.count_distinct("doc_id").alias("n")).collect()
    assert [tuple(r) for r in got] == [("MIT", 1, 1, 0, 60_000)]


def test_templates_out_of_bounds(spark):
    for bad in ({"short": "only four words here"}, {str(i): "one two three four five" for i in range(lic.TEMPLATES + 1)}):
        with pytest.raises(ValueError, match="templates"):
            lic.find_licenses(frame(spark, {1: "a"}), bad)


def test_license_plan_is_native(spark, capsys):
    lic.find_licenses(frame(spark, {1: "a"})).explain()  # not "formatted": that also names the call that made the fixture's rows
    plan = capsys.readouterr().out
    assert "Generate" in plan and not any(w in plan for w in ("Python", "Pandas", "Arrow"))


TEXTS = ["Hello world", "", " leading", "two  spaces   here ", "naïve café\nnew line\ttab", "日本語 🙂", "▁mark▁ and \x00 nul", "a" * 300, "don't STOP 123 4567", "Eauouon.\nEnpaeux leaux le ouè eauenaux."]


def test_without_dropout_it_is_sentencepiece():
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    m = sp.model(PATH)
    for t in TEXTS:
        if "▁" not in t and "\x00" not in t:
            assert m.encode(t) == lib.encode(t), t


def test_round_trip_and_variation():
    m = sp.model(PATH)
    for t in TEXTS:
        for rate in (0.0, 0.1, 0.5, 1.0):
            for seed in (1, 2):
                ids = m.encode(t, rate, seed, 7)
                assert m.decode(ids) == t
                assert ids == m.encode(t, rate, seed, 7)
    text = "segmentation varies with seeds and documents " * 5
    assert len({tuple(m.encode(text, 0.3, seed, key)) for seed in range(3) for key in range(3)}) == 9
    assert len(m.encode(text, 0.5, 1)) > len(m.encode(text))


def test_frames(spark):
    texts = dict(enumerate(TEXTS)) | {99: None}
    coded = sp.encode(frame(spark, texts), PATH, dropout=0.2, seed=5)
    back = {r.doc_id: r.text for r in sp.decode(coded, PATH).collect()}
    assert back == texts
    rows = {r.doc_id: r for r in sp.round_trip(frame(spark, texts), PATH, dropout=0.2, seed=5).collect()}
    assert all(rows[i].n_chars == (None if t is None else len(t)) for i, t in texts.items())
    assert sp.encode(frame(spark, {}), PATH).count() == 0


def agenda(lib, text: str, rate: float, seed: int, doc: int) -> list[int]:
    """Ids by trying all adjacent parts after every merge: the best score, then the leftmost, unless its draw skips it for good."""
    known = {lib.id_to_piece(i): i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    out: list[int] = []
    for place, word in enumerate(re.findall(" +[^ ]*", " " + text if text else "")):
        key = sp.occurrence_key(seed, doc, place)
        parts = [(i, i + 1, sp.MARK if c == " " else "literal mark" if c == sp.MARK else c, c) for i, c in enumerate(word)]
        skipped: set = set()
        while True:
            pairs = [(a[0], b[1], j) for j, (a, b) in enumerate(itertools.pairwise(parts)) if a[2] in known and b[2] in known and a[2] + b[2] in known]
            pairs = [(-lib.get_score(known[parts[j][2] + parts[j + 1][2]]), i, e, j) for i, e, j in pairs if (i, e) not in skipped]
            if not pairs:
                break
            _, i, e, j = min(pairs)
            if sp.drawn(i << 32 | e, key) < int(rate * 2**32):
                skipped.add((i, e))
            else:
                parts[j : j + 2] = [(i, e, parts[j][2] + parts[j + 1][2], "")]
        for _, _, piece, raw in parts:
            out += [known[piece]] if piece in known else [lib.piece_to_id(f"<0x{x:02X}>") for x in raw.encode()]
    return out


def test_encoding_is_that_of_an_exhaustive_agenda():
    lib, m, rnd = sentencepiece.SentencePieceProcessor(model_file=PATH), sp.model(PATH), random.Random(4)
    texts = [*TEXTS, "the segmentation of the 日本 wordsꙮ and ꙮꙮtokens " * 30, "the cat and the cat and the " * 20, "x" * 60 + " y" * 70]
    texts += [" ".join("".join(rnd.choice("aeinorstlhdéu.\n▁ꙮ ") for _ in range(rnd.randrange(1, 30))) for _ in range(40)) for _ in range(15)]
    for rate in (0.0, 0.1, 0.6, 1.0):
        got = m.encode_all(texts, list(range(5, 5 + len(texts))), rate, 9)
        for i, t in enumerate(texts):
            assert got[i].tolist() == agenda(lib, t, rate, 9, 5 + i), (t, rate)
            assert m.encode_all([t], [5 + i], rate, 9)[0].tolist() == got[i].tolist()


def test_words_whose_hashes_agree_stay_apart(monkeypatch):
    m = sp.model(PATH)
    texts = ["some words here and some more words here of any size " * 3, "words"]
    want = [x.tolist() for x in m.encode_all(texts, [1, 2], 0.2, 3)]
    monkeypatch.setattr(m, "salt", np.zeros_like(m.salt))
    assert [x.tolist() for x in m.encode_all(texts, [1, 2], 0.2, 3)] == want


def test_every_occurrence_draws_for_itself():
    m = sp.model(PATH)
    plain = m.encode("segmentation")
    words = [tuple(m.encode(" segmentation" * 400, 0.1, 3, key)) for key in range(20)]
    assert len(set(words)) == 20
    ids = m.encode("segmentation " * 8000, 0.1, 3, 1)
    at = [k for k, i in enumerate(ids) if m.raw[i].startswith(b" ")] + [len(ids)]
    kinds = {tuple(ids[a:z]) for a, z in zip(at, at[1:], strict=False)}
    assert len(kinds) > 20 and tuple(plain) in kinds
    # of a word of one merge, each occurrence is split at the rate, not at a multiple of 1/8
    pair = next(p for p in m.ids if len(p) == 2 and p[0] == sp.MARK and p[1].isalpha() and p[1] in m.ids)
    n, rate = 20_000, 0.1
    split = m.encode(" ".join([pair[1]] * n), rate, 3, 1).count(m.ids[sp.MARK])
    assert abs(split / n - rate) < 0.01


def test_repeated_rows_and_null_texts(spark):
    rows = [(1, "the same text again"), (1, "the same text again"), (None, "the same text again"), (2, None), (3, "")]
    got = sorted(map(tuple, sp.round_trip(frame(spark, rows), PATH, dropout=0.4, seed=5).collect()), key=str)
    assert got.count(next(r for r in got if r[0] == 1)) == 2 and (2, None, None, None, None) in got and (3, 0, 0, 0, 0) in got
    assert len({r[1:] for r in got if r[0] is None}) == 1
