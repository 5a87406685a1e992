from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from quire.llm import op9_language as lang
from quire.llm import op10_ctw as ctw

from .helpers import DOCS, WORD, frame, lower


def fold(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


SAMPLES = {"en": "the of and to in is that for it with as was on be by at", "de": "der die und das nicht ein ist zu mit sich auf für", "fr": "le la les des une est dans que pour qui pas sur"}


def corpus(n: int = 240, seed: int = 1):
    rnd = random.Random(seed)
    langs, texts = {}, {}
    for i in range(n):
        langs[i] = rnd.choice(list(SAMPLES))
        texts[i] = " ".join(rnd.choice(SAMPLES[langs[i]].split()) for _ in range(rnd.choice([5, 30, 80]))).capitalize() + "."
    return texts, langs


def brute_grams(text) -> Counter:
    out: Counter = Counter()
    w = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for x in w:
        p = f"_{x}_"
        out.update([c for c in x] + [p[i : i + 2] for i in range(len(p) - 1)] + [p[i : i + 3] for i in range(len(p) - 2)])
    return out


def code(g: str) -> int:
    return sum(ord(c) << (21 * i) for i, c in enumerate(g))


def test_profiles_against_brute_force(spark):
    texts, langs = corpus()
    texts |= {900: None, 901: "123 !!", 902: "", 903: "Ünïcödé 日本", 904: "x" * 50_000}
    langs |= {900: "en", 901: None, 902: "de", 903: None, 904: None}
    counts: dict = {}
    for i, t in texts.items():
        if langs[i] and t is not None and fold(i, 3) != 1:
            counts.setdefault(langs[i], Counter()).update(brute_grams(t))
    ranked = lambda c, k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:k]]
    profiles = {x: {g: r for r, g in enumerate(ranked(c, lang.PROFILE))} for x, c in counts.items()}
    got = {r.doc_id: r for r in lang.identify(frame(spark, texts, langs)).collect()}
    right = 0
    for i, t in texts.items():
        own = ranked(brute_grams(t), lang.TOP)
        assert got[i].held_out == (fold(i, 3) == 1)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        d = {x: sum(abs(r - p[g]) if g in p else lang.PROFILE for r, g in enumerate(own)) for x, p in sorted(profiles.items())}
        best = min(d, key=d.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - d[best] / (lang.PROFILE * len(own)))
        right += i < 900 and best == langs[i]
    assert right >= 0.97 * 240


def test_language_odd_tables(spark):
    assert lang.identify(frame(spark, {})).count() == 0
    got = lang.identify(frame(spark, {1: "the"}, {1: None})).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    texts, langs = corpus(60)
    docs = frame(spark, texts | {900: None, 901: "12 34", 902: ""}, langs | {900: "en", 901: "en", 902: "en"})
    kept = lang.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_tied_languages_and_repeated_rows(spark):
    ids = [i for i in range(60) if fold(i, 3) != 1][:12]
    text = "the same words teach both languages alike"
    rows = [(i, text, "bb" if k % 2 else "aa", "s", 0, "k", 7, 7, "x", "y", "z", 1) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, text, None, "s", 0, "k", 7, 7, "x", "y", "z", 1)], DOCS)
    got = [(r.doc_id, r.lang_pred, r.score) for r in lang.identify(df).collect()]
    assert len(got) == len(ids) + 4 and {p for _, p, _ in got} == {"aa"} and len({s for _, _, s in got}) == 1


def brute_ctw(train: list[bytes], depth: int):
    """Counts and probabilities of every node by recursion."""
    counts: dict = {}
    for raw in train:
        s = bytes([255]) * depth + raw + b"\xff"
        for i in range(depth, len(s)):
            for k in range(8):
                node, bit = (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((node, s[i - d : i]), [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children: dict = {}
    for node, c in counts:
        if c:
            children.setdefault((node, c[1:]), []).append(c)
    weight: dict = {}

    def pw(node, c):
        if (node, c) not in weight:
            a, b = counts[node, c]
            e = kt(a, b)
            if len(c) == depth:
                weight[node, c] = (e, 1.0)
            else:
                low = sum(pw(node, x) for x in children.get((node, c), ()))
                m = max(e, low)
                w = math.log(0.5) + m + math.log(math.exp(e - m) + math.exp(low - m))
                weight[node, c] = (w, math.exp(math.log(0.5) + e - w))
        return weight[node, c][0]

    def chance(node, context):
        """Of a one."""
        p, rest = 0.0, 1.0
        for d in range(depth + 1):
            c = context[depth - d :]
            a, b = counts.get((node, c), (0, 0))
            if (node, c) in counts:
                pw(node, c)
                stop = weight[node, c][1]
            else:
                stop = 1.0 if d == depth else 0.5
            p += rest * stop * (b + 0.5) / (a + b + 1)
            rest *= 1 - stop
        return p

    def score(raw):
        s = bytes([255]) * depth + raw + b"\xff"
        total = 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                p = chance((1 << k) | (s[i] >> (8 - k)), s[i - depth : i])
                total += math.log10(p if (s[i] >> (7 - k)) & 1 else 1 - p)
        return total

    return score


@pytest.mark.parametrize("depth", [1, 3, ctw.DEPTH])
def test_weighting_against_recursion(spark, depth):
    texts, _ = corpus(50, seed=4)
    texts = {i: t[:60] for i, t in texts.items()} | {900: None, 901: "", 902: "é日\x00", 903: "zzzz never seen zzzz"}
    got = {r.doc_id: r for r in ctw.score(frame(spark, texts), depth=depth).collect()}
    train = {i: t or "" for i, t in texts.items() if fold(i, 7) != 2}
    model = brute_ctw([t.encode() for t in train.values()], depth)
    tokens = Counter(w for t in train.values() for w in [*WORD.findall(lower(t)), None])
    total, kinds = sum(tokens.values()), len(tokens)
    for i, t in texts.items():
        w = [*WORD.findall(lower(t or "")), None]
        r = got[i]
        assert r.held_out == (fold(i, 7) == 2) and r.n_tokens == len(w) and r.n_known == sum(tokens[x] > 0 for x in w) and r.train_tokens == total
        assert r.base_score == pytest.approx(sum(math.log10((tokens[x] + 1) / (total + kinds + 1)) for x in w))
        assert r.score == pytest.approx(model((t or "").encode()))
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len((t or "").encode()) + 1))


def test_a_choice_has_probabilities_that_sum_to_one(spark):
    import pyspark.sql.functions as F

    grams = spark.range(256).select((F.lit(ord("a") << 8) + F.col("id")).alias("key"), F.when(F.col("id") == 98, 5).otherwise(0).cast("long").alias("n"))
    total = ctw.model(grams, 1).agg(F.sum(F.pow(F.lit(10.0), F.col("lp")))).first()[0]
    assert total == pytest.approx(1.0)


def test_scores_of_odd_tables(spark):
    assert ctw.score(frame(spark, {})).count() == 0
    got = ctw.score(frame(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert len(got) == 3 and all(r.score < 0 for r in got)
    held = next(i for i in range(100) if fold(i, 7) == 2)
    only = ctw.score(frame(spark, {held: "abc"})).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.bits_per_byte == pytest.approx(8.0)
