"""Texts with blanks at their ends, empty lines and characters of no single-byte encoding; documents that occur more than once."""

from __future__ import annotations

import base64
import os
import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.kernel import aes, content, crypto, filters, lexer, synth, xref
from quire.kernel.base import PdfError
from quire.kernel.document import Document
from quire.operators import batches, tables
from quire.plans import catalogue, relational
from quire.sources import synthetic

ODD = ["", " ", "\n", " a", "a ", "\na", "a\n", "a\n\nb", "a  b", " a \n b ", "\xa0a\xa0", "\n" * 100, "þÿab", "€ ¤", "中文 \U0001f600", "a\rb", "".join(map(chr, range(256, 700))), None]
EXACT = [
    "text_plain", "text_flate", "text_hex", "text_objstm", "text_xref_pred12", "text_recovered", "text_macroman", "text_tounicode", "text_ttf", "text_cff", "text_tj_kerning",
    "text_rc4_40", "text_rc4_128", "text_aes128", "page_text", "one_page", "pack_roundtrip", "rewrite_roundtrip",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", EXACT)
def test_texts_come_back_as_they_are(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in catalogue.queries()[name](spark, odd).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("text", ["1 0 obj ", "a\n5 0 obj\n<< >>", "trailer << /Root 5 0 R >>", "trailer\n<< /Root 1 0 R >>\n1 0 obj\n(x)", "7 0 obj << /Type /Catalog >> endobj", "endstream endobj 2 0 obj"])
def test_recovery_passes_by_what_streams_hold(text):
    d = Document.load(synth.build(text, layout="severed"))
    assert d.xref.recovered and d.object_count() == 5 and [d.page_text(n, exact=True) for n in d.page_ids()] == [text]


def test_recovery_keeps_objects_behind_a_stream_of_no_length():
    raw = b"1 0 obj << /Type /Catalog >> endobj 4 0 obj << /Length 99 >> stream\nx\n6 0 obj 5 endobj\nendstream endobj 7 0 obj 8 endobj"
    assert sorted(xref.repair(raw).entries) == [1, 4, 6, 7]


def test_the_general_text_still_folds_blanks(spark):
    files = synthetic.documents(spark.createDataFrame([(1, " a\n\nb ")], "doc_id long, text string"))
    assert tables.document_text(files).first().text == "a\nb" and tables.document_text(files, exact=True).first().text == " a\n\nb "


def test_equal_documents_are_worked_on_once(spark):
    def rows(doc_id, content):
        yield doc_id, content, os.urandom(8).hex()

    files = spark.range(25_000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3).cast("string")).alias("content"))
    run = lambda **o: batches.map_documents(files, rows, "doc_id bigint, content string, mark string", ["doc_id", "content"], **o)
    assert run().agg(F.count_distinct("mark"), F.count_distinct("doc_id"), F.count("*")).first()[:] == (3, 25_000, 25_000)
    assert run().join(files.withColumnRenamed("content", "own"), "doc_id").where("content <> own").isEmpty()
    assert run(once=False).agg(F.count_distinct("mark")).first()[0] == 25_000


def test_rows_of_equal_and_of_long_documents_are_whole(spark):
    def rows(doc_id, n, tag):
        for i in range(n or 0):
            yield doc_id, i, tag, [tag, str(i)] if tag else None

    sizes = [0, 1, 3, None, 64, 65, 5000, 70_000]
    docs = [(i, sizes[i * 7 % 8] if i < 60 else sizes[i % 6], None if i % 5 == 0 else f"t{i % 2}") for i in range(400)]
    got = batches.map_documents(spark.createDataFrame(docs, "doc_id long, n int, tag string").coalesce(1), rows, "doc_id bigint, i int, tag string, l array<string>", ["doc_id", "n", "tag"])
    ok = "(tag is null and l is null) or (l[0] = tag and l[1] = cast(i as string))"
    by_doc = {r.doc_id: r for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d"), F.max("i").alias("top"), F.max("tag").alias("tag"), F.expr(f"bool_and({ok})").alias("ok")).collect()}
    want = {d: (n, tag) for d, n, tag in docs if n}
    assert {d: (r.n, r.tag) for d, r in by_doc.items()} == want
    assert all(r.ok and r.d == r.n == r.top + 1 for r in by_doc.values())


def test_ascii85_by_arrays():
    rnd = random.Random(2)
    for n in [*range(40), 1000, 4097]:
        for raw in (rnd.randbytes(n), bytes(n), bytes(n // 2) + rnd.randbytes(n - n // 2), b"\xff" * n):
            assert filters.ascii85_encode(raw) == base64.a85encode(raw) and filters.ascii85(base64.a85encode(raw) + b"~>") == raw
    assert filters.ascii85(b"s8W-$") == b"\xff\xff\xff\xff" and filters.ascii85(b"!") == b""
    with pytest.raises(PdfError, match="z inside"):
        filters.ascii85(b"z!!z")
    text = "a long text " * 20_000
    start = time.perf_counter()
    assert filters.ascii85(filters.ascii85_encode(text.encode())) == text.encode() and time.perf_counter() - start < 0.02


def test_ciphers_by_the_system_and_kept_keys():
    rnd = random.Random(3)
    for size in (16, 24, 32):
        for n in (0, 16, 160, 4000):
            args = rnd.randbytes(n), rnd.randbytes(size), rnd.randbytes(16)
            assert aes.cbc_encrypt_raw(*args) == aes.cbc_encrypt_blocks(*args)
    assert crypto.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3" and crypto.rc4(bytes(700), b"Wiki").hex()[:16] == crypto.rc4(bytes(8), b"Wiki").hex()
    raw = synth.build("text", cipher="rc4_128", password=b"open", seed=b"corpus")
    for _ in range(2):
        crypto.user_entry.cache_clear()
        with pytest.raises(PdfError):
            Document.load(raw, b"wrong")
        before = crypto.user_entry.cache_info().misses
        with pytest.raises(PdfError):
            Document.load(raw, b"wrong")
        assert crypto.user_entry.cache_info().misses == before


def test_batches_of_long_documents_are_cut():
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "content": [b"x" * 300_000] * 100})
    parts = list(batches.sliced([b]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and max(p.num_rows for p in parts) * 300_000 <= batches.PART_BYTES
    assert [p.num_rows for p in batches.sliced([b.slice(0, 5)])] == [5]


def test_a_page_tree_parses_documents_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    files = synthetic.documents(spark.createDataFrame([(i, "a\nb") for i in range(20)], "doc_id long, text string"), per_page=1)
    tree = relational.page_tree(tables.object_kv(files.mapInArrow(count, files.schema)))
    assert tree.count() == 40 and parsed.value == 20


def test_tokens_of_wanted_columns_are_those_of_all(spark):
    docs = [b"[1 2 1.5 /O (a\\(b)]% rest", None, b"", b"<< /K <41> >> )", b"7 " * 70_000, b"true (x", b"-3 (a(b)c) %"] * 3
    files = spark.createDataFrame(list(enumerate(docs)), "doc_id long, content binary").coalesce(1)
    whole = tables.tokens(files)
    want = [(n, seq, *tables.token_row(*t)) for n, d in enumerate(docs) for seq, t in enumerate(lexer.tokens(d or b""))]
    assert sorted(map(tuple, whole.collect()), key=lambda r: r[:2]) == want
    for names in (["seq", "kind", "i"], ["kind", "bytes"]):
        some = tables.tokens(files, columns=names)
        assert some.columns == ["doc_id", *names] and some.exceptAll(whole.select("doc_id", *names)).isEmpty() and some.count() == len(want)


#: More characters than two bytes number, and a text of blanks.
MANY = ["".join(map(chr, [*range(32, 0xD800), *range(0xE000, 0x13000)])), "  a  b "]
NUMBERED = [
    "text_tounicode",
    "text_tj_kerning",
    "text_rc4_128",
    "text_rc4_40",
    "text_plain",
    "page_text",
    "text_hex",
    "text_macroman",
    "text_objstm",
    "text_xref_pred12",
    "rewrite_roundtrip",
]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    spark.createDataFrame(list(enumerate(MANY)), "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", NUMBERED)
def test_texts_of_very_many_characters_come_back(spark, many, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{many}/documents.parquet/*.parquet')")
    assert sorted(tuple(r) for r in catalogue.queries()[name](spark, many).collect()) == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())


def test_short_cuts_read_as_the_whole_grammar_does():
    shown = lambda raw: list(content.operations(raw))
    assert shown(b"[(a b) -250 () 7(c)]TJ [(x)]TJ\n") == [("TJ", [[b"a b", -250, b"", 7, b"c"]]), ("TJ", [[b"x"]])]
    assert shown(b"[(a\\)) 1.5 (b(c))] TJ") == [("TJ", [[b"a)", 1.5, b"b(c)"]])] and shown(b"[1-2] TJ") == [("TJ", [[1, -2]])]
    assert lexer.unescape(b"\\(a\\)\\\\n") == b"(a)\\n" and lexer.unescape(b"\\(\\n\\") == b"(\n"
    key, raw = b"Key", bytes(300_000)
    assert crypto.rc4(raw[:700], key) == crypto.rc4(raw, key)[:700] and crypto.rc4(raw[:9], key) == crypto.rc4(raw[:700], key)[:9]


#: What a text could be misread by: syntax of the file around it, line ends, blanks, byte order marks and characters that fonts lack.
PIECES = [
    "endstream", "endobj", "xref", "trailer << /Root 9 0 R >>", "startxref\n9", "stream\r\n", "1 0 obj ", "BT", "ET", "(a) Tj", "T*", " EI ", "[(", ")]TJ",
    "<FEFF>", "(", ")", "\\", "\\053", "%", "~>", "\n", "\r", "\n\n", " ", "  ", "\t", "\x00",
    "\x81", "\xa0", "\u3000", "\ufeff", "\xfe\xff", "\xef\xbb\xbf", "\u20ac", "\xa4", "\u03a9", "\u2126", "\u4e2d", "\U0001f600", "word",
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(rnd.sample(PIECES, some), k=size)) for some in (2, 5, len(PIECES)) for size in (1, 2, 7, 50, 600) for _ in range(8)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", NUMBERED)
def test_texts_of_syntax_come_back(spark, awkward, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{awkward}/documents.parquet/*.parquet')")
    assert sorted(tuple(r) for r in catalogue.queries()[name](spark, awkward).collect()) == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())
