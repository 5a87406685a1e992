from __future__ import annotations

import corpus_pipeline as pipe
from quire.llm import op2_secrets, op4_packing
from quire.llm.catalogue import oracle_sql, queries, tokenizer

from .helpers import closed, shingles


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    found = pipe.identified(spark, docs, sf)
    assert found.columns == docs.columns
    assert {r.doc_id for r in found.collect()} == {i for i, r in start.items() if any(c.isalpha() for c in r.text)}
    kept = pipe.deduplicated(spark, found, sf)
    assert kept.columns == docs.columns
    sets = {i: shingles(r.text, 5) for i, r in start.items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = closed(ids, links)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in ids if low[i] == i]
    clean = pipe.redacted(spark, kept, sf)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    for r in clean.collect():
        t = start[r.doc_id].text
        spans = op2_secrets.base_spans(t) + op2_secrets.structural_spans(t)
        assert r.text == (op2_secrets.masked(t, spans) if spans else t) and r.n_chars == len(r.text)
        assert not op2_secrets.base_spans(r.text)
    final = pipe.packed(spark, clean, sf).collect()
    encode = op4_packing.encoder(tokenizer("byte_bpe_50k.json"))
    by: dict = {}
    for r in final:
        by.setdefault(r.doc_id, []).append(r)
    for r in clean.collect():
        assert [x for p in sorted(by[r.doc_id], key=lambda p: p.piece) for x in p.ids] == [*encode(r.text), 2]


def test_null_columns_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "a b c d e f", "en", None, None), (1, "a b c d e f", "en", None, None), (None, "words without a name", None, None, None), (2, "!!", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for _, f in pipe.STAGES[:3]:
        df = f(spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in df.collect()) == [(0, "words without a name"), (1, "a b c d e f")]
    empty = spark.createDataFrame([], schema)
    for _, f in pipe.STAGES:
        empty = f(spark, empty, "")
    assert empty.count() == 0


def test_each_row_is_judged_by_its_own_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_0 int"
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue white black grey"
    rows = [(1, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, None), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", None, None, 3) for i, t in rows], schema).repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in pipe.deduplicated(spark, df, "").collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (None, c), (7, None), (8, None), (9, "")], key=str)
    assert pipe.deduplicated(spark, df, "").columns == df.columns


def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(oracle_sql()) <= set(names)
    assert [n for n, _ in pipe.STAGES] == ["language", "near_duplicates", "secrets", "packing"]


def test_texts_of_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = ["Быстрая коричневая лиса прыгает через ленивую собаку", "これは日本語の文章です", "Nopea ruskea kettu hyppää laiskan koiran yli", "xq zv kjw qqp wvx"]
    clean = ["The committee will meet again on the second day of the month.", "Der Ausschuss wird sich am zweiten Tag des Monats wieder treffen."]
    rows = [(1_000_000 + i, t, None, None, len(t)) for i, t in enumerate(foreign + clean)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select([c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")])
    kept = {r.doc_id for r in pipe.identified(spark, docs.unionByName(more, allowMissingColumns=True), sf).collect()}
    assert {i for i in kept if i >= 1_000_000} == {1_000_004, 1_000_005}
    assert len(kept) == docs.count() + 2


def test_text_in_an_unknown_script_goes_whatever_was_learned(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, "a b c d e f", "en", None, None), (2, "Быстрая лиса", None, None, None)], schema)
    assert [r.doc_id for r in pipe.identified(spark, df, "").collect()] == [1]
