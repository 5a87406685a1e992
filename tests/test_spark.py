"""Relations, functions, sources and sinks on Spark, against the source columns and hand-made documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import builtin as B
from quire.functions import scalar as P
from quire.functions import table_functions as T
from quire.kernel import synth
from quire.operators import sink, tables
from quire.plans import metrics, relational
from quire.sources import datasource, synthetic
from quire.sources.files import from_bytes, read_at, read_pdfs


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, synth.build("eins\nzwei", per_page=1)), (2, synth.build("drei", layout="packed12")), (3, b"no document"), (4, synth.build("vier", layout="severed")), (5, b"")]
    return from_bytes(spark, rows)


def test_load_and_errors(mixed):
    got = {r.doc_id: r for r in tables.load(mixed).collect()}
    assert [got[i].ok for i in range(1, 6)] == [True, True, False, True, False]
    assert got[3].error.kind == "RecoveryFailed" and got[4].recovered and not got[1].recovered
    strict = {r.doc_id: r.ok for r in tables.load(mixed, "strict").collect()}
    assert strict == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_texts_pages_and_errors(mixed):
    got = {(r.doc_id, r.page_no): (r.text, r.error and r.error.kind) for r in tables.page_text(mixed).collect()}
    assert got == {(1, 1): ("eins", None), (1, 2): ("zwei", None), (2, 1): ("drei", None), (3, None): (None, "RecoveryFailed"), (4, 1): ("vier", None), (5, None): (None, "RecoveryFailed")}
    assert [(r.page_no, r.page_obj_id) for r in tables.pages(mixed.where("doc_id = 1")).collect()] == [(1, 4), (2, 6)]
    assert tables.page_text(mixed, {2}).where("error is null").count() == 1


def test_objects(mixed):
    kinds = {(r.obj_id, r.kind) for r in tables.objects(mixed.where("doc_id = 2")).collect()}
    assert (1, "dict") in kinds and (5, "stream") in kinds
    root = tables.trailer(mixed.where("doc_id = 2")).where("key = 'Root'").select(F.try_variant_get("value", "$.id", "int")).first()[0]
    assert root == 1
    s = tables.streams(mixed.where("doc_id = 1"), decoded=True).collect()
    assert len(s) == 2 and b"Tj" in bytes(s[0].decoded)


def test_page_tree_and_reachability(spark, mixed):
    kv = tables.object_kv(mixed.where("doc_id in (1, 2)"))
    assert sorted((r.doc_id, r.page_no, r.page_obj_id) for r in relational.page_tree(kv).collect()) == [(1, 1, 4), (1, 2, 6), (2, 1, 4)]
    assert relational.reachable(kv, spark.createDataFrame([(1, 1)], "doc_id long, obj_id long")).count() == 7


def test_cycles_in_a_page_tree_end(spark):
    raw = b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type /Pages /Kids [3 0 R 4 0 R]>> endobj 3 0 obj <</Type /Pages /Kids [2 0 R]>> endobj 4 0 obj <</Type /Page>> endobj trailer <</Root 1 0 R>>"
    assert [r.page_obj_id for r in relational.page_tree(tables.object_kv(from_bytes(spark, [(1, raw)]))).collect()] == [4]
    assert [r.page_obj_id for r in tables.pages(from_bytes(spark, [(1, raw)])).collect()] == [4]


def test_dangling(spark):
    raw = b"1 0 obj <</Type /Catalog /Pages 9 0 R>> endobj trailer <</Root 1 0 R>>"
    f = from_bytes(spark, [(1, raw)])
    assert [(r.from_id, r.to_id) for r in relational.dangling(tables.object_kv(f), tables.xref(f)).collect()] == [(1, 9)]


def test_sink_round_trip(mixed):
    done = sink.packed(mixed)
    assert {r.doc_id: r.text for r in tables.document_text(done.where("error is null").select("doc_id", "content")).collect()} == {1: "eins\nzwei", 2: "drei", 4: "vier"}
    assert sink.report(done).where("packed_bytes is not null").count() == 3
    again = sink.rewritten(mixed.where("doc_id = 2")).select("doc_id", "content")
    assert tables.load(again, "strict").first().ok


def test_files_and_data_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(synth.build("eins\nzwei", per_page=1))
    (tmp_path / "sub" / "b.PDF").write_bytes(synth.build("drei"))
    (tmp_path / "c.txt").write_text("no")
    files = read_pdfs(spark, str(tmp_path))
    assert sorted(r.text for r in tables.page_text(files).collect()) == ["drei", "eins", "zwei"]
    assert read_pdfs(spark, str(tmp_path), str(tmp_path / "sub")).count() == 3
    datasource.register(spark)
    df = spark.read.format("quire").load(str(tmp_path))
    assert sorted((r.page_no, r.text) for r in df.collect()) == [(1, "drei"), (1, "eins"), (2, "zwei")]
    assert [r.text for r in df.where("page_no = 2").collect()] == ["zwei"]
    out = tmp_path / "out"
    sink.packed(files).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "content").write.format("quire").mode("append").save(str(out))
    assert len(list(out.glob("*.pdf"))) == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import quire.__main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "a.pdf").write_bytes(synth.build("eins\nzwei", per_page=1))
    (tmp_path / "b.pdf").write_bytes(b"no document")
    assert cli.main(["extract-text", str(tmp_path / "a.pdf")]) == 0 and capsys.readouterr().out == "eins\nzwei\n"
    assert cli.main(["extract-text", str(tmp_path / "a.pdf"), "--page", "2"]) == 0 and capsys.readouterr().out == "zwei\n"
    assert cli.main(["extract-text", str(tmp_path / "a.pdf"), "--page", "0"]) == 2
    assert cli.main(["inspect", str(tmp_path)]) == 0 and "RecoveryFailed" in capsys.readouterr().out
    assert cli.main(["pack", str(tmp_path), str(tmp_path / "out")]) == 0 and [p.name for p in (tmp_path / "out").iterdir()] == ["a.pdf"]
    assert cli.main(["bench", str(tmp_path), "--cold"]) == 0 and "RecoveryFailed" in capsys.readouterr().out
    assert cli.main(["probe", str(tmp_path / "a.pdf")]) == 0 and "grown_kb" in capsys.readouterr().out
    for folder, text in (("one", "eins"), ("two", "zwei")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.pdf").write_bytes(synth.build(text))
    assert cli.main(["pack", str(tmp_path / "in"), str(tmp_path / "both")]) == 0
    packed = {p.parent.name: tables.document_text(read_pdfs(spark, str(p))).first().text for p in (tmp_path / "both").rglob("*.pdf")}
    assert packed == {"one": "eins", "two": "zwei"}


def test_files_stay_in_their_folder(spark, tmp_path):
    datasource.register(spark)
    bad = spark.createDataFrame([("../outside.pdf", bytearray(b"x"))], "name string, content binary")
    with pytest.raises(Exception, match="outside the folder"):
        bad.write.format("quire").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "outside.pdf").exists()


def test_streaming_ingest(spark, tmp_path):
    from quire.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(synth.build("eins"))
    run = lambda: ingest.text_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    run()
    (tmp_path / "in" / "b.pdf").write_bytes(synth.build("zwei"))
    run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["eins", "zwei"]


def test_sql_functions(spark):
    P.register(spark)
    row = spark.sql("""SELECT decode(pdf_decode(x'34383639', 'AHx'), 'UTF-8') a, pdf_decode_error(x'7a7a', 'Fl') b, pdf_glyph_to_unicode('uni20AC') c,
        pdf_decode_text(x'80', 'MacRomanEncoding') d, hex(pdf_rc4(cast('Plaintext' as binary), cast('Key' as binary))) e, pdf_decode(x'00', 'LZW') f,
        hex(pdf_ccitt_decode(x'36C0', -1, 8, 1, true)) g, hex(pdf_unescape(cast('a\\\\051' as binary))) h""").first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h) == ("Hi", "Io", "€", "Ä", "BBF316E8D940AF0AD3", None, "0F", "6129")


def test_table_functions(spark, mixed):
    T.register(spark)
    mixed.createOrReplaceTempView("mixed_files")

    def rows(name: str, columns: str, where: str = "true") -> list[tuple]:
        return sorted(tuple(r) for r in spark.sql(f"SELECT f.doc_id, {columns} FROM mixed_files f, LATERAL {name}(f.content) t WHERE {where}").collect())

    assert rows("pdf_pages", "page_no, page_obj_id", "doc_id < 3") == [(1, 1, 4), (1, 2, 6), (2, 1, 4)]
    assert rows("pdf_text", "page_no, text") == [(1, 1, "eins"), (1, 2, "zwei"), (2, 1, "drei"), (4, 1, "vier")]
    assert rows("pdf_spans", "text, is_bold", "doc_id = 2") == [(2, "drei", False)]
    for name, kept in (("pdf_xref", tables.xref(mixed)), ("pdf_objects", tables.objects(mixed).where("error is null")), ("pdf_operations", tables.operations(mixed).where("error is null"))):
        assert len(rows(name, "1")) == kept.count()
    assert [r[2] for r in rows("pdf_tokens", "seq, kind", "doc_id = 3")] == ["keyword", "keyword"]
    page = "00000000" + "30" + "00" + "01" + "00000013" + "00000040" + "00000008" + "00" * 11
    assert [tuple(r) for r in spark.sql(f"SELECT number, type, page, length(payload) FROM jbig2_segments(x'{page}')").collect()] == [(0, 48, 1, 19)]


def test_fonts(spark):
    f = from_bytes(spark, [(1, synth.build("ab\nba", font="tounicode")), (2, synth.build("ab", font="macroman")), (3, b"no document")])
    got = {r.doc_id: r for r in tables.fonts(f).collect()}
    assert got[1].codes > 0 and got[2].codes == 0 and got[2].encoding == "MacRomanEncoding" and got[3].error.kind == "RecoveryFailed"
    assert {"a", "b"} <= {r.text for r in tables.font_codes(f).where("doc_id = 1").collect()}
    assert tables.font_codes(f).where("doc_id <> 1").count() == 0


def test_builtin_edges(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4\nxx startxref\n5"),), (bytearray(b"none"),)], "c binary")
    assert [tuple(r) for r in df.select(B.header_version(F.col("c")), B.last_startxref(F.col("c")), read_at(F.col("c"), F.lit(1), F.lit(3)), read_at(F.col("c"), F.lit(2), F.lit(99))).collect()] == [("1.4", 5, bytearray(b"PDF"), None), ("Unknown", None, bytearray(b"one"), None)]
    n = spark.range(1).select(B.rect(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("r"), B.inverse(B.matrix(1, 1, 1, 1, 0, 0)).alias("i"), B.real_string(F.lit(1.5)).alias("s"), B.ascii_hex(F.lit("4x>")).alias("h"), B.matrix_string(B.matrix(1, 0, 0, 1, 0, 2)).alias("m"), B.font_style(F.lit("Demi")).alias("f"), B.default_width(F.lit("m")).alias("w")).first()
    assert n.r.min_x == 1.0 and n.i is None and n.s == "1.5" and n.h is None and n.m == "[1.000 0.000 0.000 1.000 0.000 2.000]" and n.f.is_bold and n.w == 750.0


def test_object_key(spark):
    import hashlib

    got = spark.range(1).select(B.object_key(F.unhex(F.lit("0102030405")), F.lit(0x10203), F.lit(7), True, 5).alias("k")).first().k
    assert bytes(got) == hashlib.md5(bytes([1, 2, 3, 4, 5, 3, 2, 1, 7, 0]) + b"sAlT").digest()


def test_windows(spark):
    starts = spark.createDataFrame([(1, 5, 10), (1, 9, 30)], "doc_id long, obj_id long, offset long")
    marks = spark.createDataFrame([(1, 5), (1, 10), (1, 30), (1, 31)], "doc_id long, pos long")
    assert [(r.pos, r.obj_id) for r in relational.enclosing(starts, marks).orderBy("pos").collect()] == [(5, None), (10, None), (30, 5), (31, 9)]


def test_metrics(spark):
    m = spark.createDataFrame([(i, 100, float(i), None if i % 2 else "Io") for i in range(1, 5)], "doc_id long, bytes long, ms double, error string")
    p, r, s = metrics.tool_percentiles(m).first(), metrics.runner_percentiles(m).first(), metrics.summary(m).first()
    assert (p.p50, p.p99) == (3.0, 4.0) and (r.p50, r.p90, r.p99) == (3.0, 4.0, 4.0) and (s.total, s.passed, s.pass_percent) == (4, 2, 50.0)
    assert [tuple(x) for x in metrics.top_errors(m).collect()] == [("Io", 2)]
    assert metrics.largest(m).first().doc_id == 1
    assert metrics.measured(synthetic.documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))).first().error is None


def test_null_texts_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert tables.document_text(synthetic.documents(none)).first().text == ""
    assert tables.document_text(synthetic.documents(none.limit(0))).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).where("error is null").count() > 200


def test_as_of_lookups_cross_partitions(spark):
    rnd = random.Random(3)
    starts = [(d, rnd.randrange(100_000), i) for d in (1, 2) for i in range(700)] + [(3, 10, 5)]
    marks = [(d, rnd.randrange(100_000)) for d in (1, 2, 3, 4) for _ in range(300)]
    frames = (spark.createDataFrame(starts, "doc_id long, offset long, obj_id long"), spark.createDataFrame(marks, "doc_id long, pos long"))
    got = sorted((r.doc_id, r.pos, r.obj_id) for r in relational.enclosing(*frames).collect())
    by_place = {(d, at): i for d, at, i in sorted(starts, key=lambda s: s[2])}
    for d, pos, obj in got:
        before = [at for e, at in by_place if e == d and at < pos]
        ties = {i for e, at, i in starts if before and e == d and at == max(before)}
        assert obj in ties if before else obj is None
    assert len(got) == len(marks)


def test_ranks_cross_partitions(spark):
    rnd = random.Random(4)
    values = [round(rnd.random() * 50, 1) for _ in range(3000)]
    m = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "ms double, half int")
    assert metrics.at_ranks(m, {"r": F.floor(F.col("n") * 3 / 4)}).first().r == sorted(values)[3000 * 3 // 4]
    halves = {r.half: r.r for r in metrics.at_ranks(m, {"r": F.lit(0) + F.col("n") - 1}, ["half"]).collect()}
    assert halves == {h: max(values[h::2]) for h in (0, 1)}
    assert metrics.at_ranks(m.where("ms < 0"), {"r": F.lit(0)}).first().r is None


def test_code_space_ranges_of_any_size(spark):
    rnd = random.Random(5)
    ranges = [(0, 2**32 - 1, "all"), (7, 7, "one"), (250, 260, "few"), (5, 4, "none")] + [(a := rnd.randrange(2**32), a + rnd.randrange(2**20), f"r{i}") for i in range(40)]
    codes = [7, 7, 255, 256, 2**32 - 1, 2**33, *(r[0] for r in ranges[4:]), *(r[1] for r in ranges[4:])]
    frames = (spark.createDataFrame([(c,) for c in codes], "code long"), spark.createDataFrame(ranges, "low long, high long, name string"))
    got = sorted((r.code, r.name) for r in relational.codespace(*frames).collect() if r.name) + sorted(r.code for r in relational.codespace(*frames).collect() if not r.name)
    assert got == sorted((c, n) for c in codes for lo, hi, n in ranges if lo <= c <= hi) + [2**33]


def test_deep_page_trees_are_an_error_not_a_cut(spark):
    nodes = b"".join(b"%d 0 obj\n<< /Type /Pages /Count 1 /Kids [%d 0 R] >>\nendobj\n" % (n, n + 1) for n in range(2, 8))
    raw = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n" + nodes + b"8 0 obj\n<< /Type /Page >>\nendobj\n"
    kv = tables.object_kv(from_bytes(spark, [(1, raw)]))
    assert [r.page_obj_id for r in relational.page_tree(kv).collect()] == [8]
    with pytest.raises(ValueError, match="levels"):
        relational.page_tree(kv, max_levels=3)
