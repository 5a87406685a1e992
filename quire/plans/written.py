"""Queries over documents that SQL expressions write, not the package's own writer, so that an error of both sides would show.

The files have no cross-reference table, and some have faults: loading them is recovery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import builtin as B
from ..functions import scalar as P
from ..operators import sink, tables
from ..sources import synthetic
from . import metrics
from .catalogue import LINES, PASSWORD, _N, _PAGES, _documents, query, read


def one_page(content: Column, *, font: str = "/Type /Font /Subtype /Type1 /BaseFont /Any", more: Column | None = None, catalog: Column | None = None, version: Column | None = None) -> Column:
    """Bytes of a one-page document without a table. Objects: 1 catalogue, 2 pages, 3 font, 4 page, 5 contents; more has further ones."""
    parts = [
        F.lit("%PDF-1."), F.lit("4") if version is None else version, F.lit("\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R "), F.lit("") if catalog is None else catalog,
        F.lit(">>\nendobj\n2 0 obj\n<< /Type /Pages /Count 1 /Kids [4 0 R] >>\nendobj\n3 0 obj\n<< "), F.lit(font),
        F.lit(" >>\nendobj\n4 0 obj\n<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents 5 0 R >>\nendobj\n5 0 obj\n<< /Length "),
        F.length(content).cast("string"), F.lit(" >>\nstream\n"), content, F.lit("\nendstream\nendobj\n"), F.lit("") if more is None else more,
    ]
    return F.encode(F.concat(*parts), "ISO-8859-1")


def _files(df: DataFrame, key: str, content: Column) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), content.alias("content"))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 1 THEN '2.' || (p_size % 3)::VARCHAR ELSE '1.' || (p_size % 8)::VARCHAR END AS version,
'1.' || (p_size % 8)::VARCHAR AS header FROM part""")
def catalog_version(s, d):
    named = F.when(F.col("p_partkey") % 2 == 1, F.format_string("/Version /2.%d ", F.col("p_size") % 3)).otherwise("")
    files = _files(read(s, d, "part"), "p_partkey", one_page(F.lit("BT ET"), catalog=named, version=(F.col("p_size") % 8).cast("string")))
    return tables.load(files).join(files.select("doc_id", B.header_version(F.col("content")).alias("header")), "doc_id").select("doc_id", "version", "header")


@query("SELECT p_partkey AS doc_id, 'Streams only' AS kind, (p_size % 5 + 1)::BIGINT AS in_use, 0::BIGINT AS compressed FROM part")
def nothing_to_pack(s, d):
    """Documents of streams only: no object can go into an object stream, so the copy is a classic file."""
    body = F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.format_string("%d 0 obj\n<< /Type /Catalog /Length 3 >>\nstream\nabc\nendstream\nendobj\n", i))
    files = _files(read(s, d, "part"), "p_partkey", F.encode(F.concat(F.lit("%PDF-1.4\n"), F.array_join(body, "")), "ISO-8859-1"))
    done = sink.packed(files).where("error is null").select("doc_id", "content")
    counts = tables.xref(done).groupBy("doc_id").agg(F.count_if(F.col("kind") == "in_use").alias("in_use"), F.count_if(F.col("kind") == "compressed").alias("compressed"))
    return counts.select("doc_id", F.lit("Streams only").alias("kind"), "in_use", "compressed")


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS text, (o_orderkey % 9 + 4)::BIGINT AS size FROM orders")
def inline_images(s, d):
    """An image among text: its bytes hold the end operator without a space before it, and are not operators."""
    image = F.concat(F.repeat(F.lit("x"), (F.col("o_orderkey") % 9 + 1).cast("int")), F.lit("EI)"))
    content = F.concat(F.lit("BI /W 1 /H 1 /BPC 8 /CS /G ID "), image, F.lit(" EI BT /F1 12 Tf ("), F.col("o_orderpriority"), F.lit(") Tj ET"))
    files = _files(read(s, d, "orders"), "o_orderkey", one_page(content))
    images = tables.operations(files).where("operator = 'ID'").select("doc_id", F.get_json_object("operands", "$[8].length").cast("bigint").alias("size"))
    return tables.document_text(files).join(images, "doc_id").select("doc_id", "text", "size")


@query("""SELECT p_partkey AS doc_id, round((300 + p_size + CASE WHEN p_partkey % 3 = 0 THEN 700 ELSE 500 END)::DOUBLE * 0.01::DOUBLE, 3) AS width,
p_size >= 25 AS is_bold, p_partkey % 2 = 1 AS is_italic FROM part""")
def font_widths(s, d):
    """A listed width, and one of a code beyond the list; weight and flags of the descriptor."""
    missing = F.when(F.col("p_partkey") % 3 == 0, F.lit("/MissingWidth 700 ")).otherwise("")
    descriptor = F.format_string("6 0 obj\n<< /Type /FontDescriptor /Flags %d /FontWeight %d ", F.when(F.col("p_partkey") % 2 == 1, 64).otherwise(4), F.when(F.col("p_size") >= 25, 700).otherwise(400))
    widths = F.format_string("7 0 obj\n[%d]\nendobj\n", F.lit(300) + F.col("p_size"))
    font = "/Type /Font /Subtype /Type1 /BaseFont /Any /FirstChar 65 /Widths 7 0 R /FontDescriptor 6 0 R"
    pages = one_page(F.lit("BT /F1 10 Tf (A\xc9) Tj ET"), font=font, more=F.concat(descriptor, missing, F.lit(">>\nendobj\n"), widths))
    out = tables.spans(_files(read(s, d, "part"), "p_partkey", pages))
    return out.select("doc_id", F.round((F.col("bbox.max_x") - F.col("bbox.min_x")).cast("double"), 3).alias("width"), "is_bold", "is_italic")


@query("SELECT doc_id, hex(encode(text)) AS bytes, CASE doc_id % 5 WHEN 0 THEN 'LZWDecode' WHEN 1 THEN 'RunLengthDecode' WHEN 2 THEN 'DCTDecode' WHEN 3 THEN 'JPXDecode' ELSE 'Crypt' END AS filter, 'UnsupportedFilter' AS error FROM documents")
def identity_and_unsupported(s, d):
    name = F.element_at(F.array(*map(F.lit, ("LZWDecode", "RunLengthDecode", "DCTDecode", "JPXDecode", "Crypt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    raw = F.encode("text", "UTF-8")
    return read(s, d, "documents").select("doc_id", F.hex(P.pdf_decode(raw, F.lit("Identity Identity"))).alias("bytes"), name.alias("filter"), P.pdf_decode_error(raw, name).alias("error"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END::INTEGER AS version, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 6 END::INTEGER AS revision,
CASE doc_id % 3 WHEN 2 THEN 256 ELSE 128 END::INTEGER AS key_bits, CASE doc_id % 3 WHEN 0 THEN 'rc4' WHEN 1 THEN 'aes128' ELSE 'aes256' END AS stream_cipher,
-4::BIGINT AS permissions, TRUE AS encrypt_metadata, CASE doc_id % 3 WHEN 2 THEN 32 ELSE 16 END::INTEGER AS dek_bytes FROM documents""")
def security_parameters(s, d):
    docs = read(s, d, "documents")
    parts = [synthetic.documents(docs.where(F.col("doc_id") % 3 == i), cipher=c, password=PASSWORD) for i, c in enumerate(("rc4_128", "aes128", "aes256_r6"))]
    out = tables.security(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return out.select("doc_id", "version", "revision", "key_bits", "stream_cipher", "permissions", "encrypt_metadata", "dek_bytes")


@query("SELECT doc_id, doc_id % 2 = 0 AS ok, CASE WHEN doc_id % 2 = 1 THEN 'Decryption' END AS error FROM documents")
def some_wrong_passwords(s, d):
    files = _documents(s, d, cipher="aes128", password=PASSWORD).withColumn("password", F.when(F.col("doc_id") % 2 == 0, F.lit(PASSWORD)).otherwise(F.lit(b"wrong")))
    return tables.load(files).select("doc_id", "ok", F.col("error.kind").alias("error"))


@query("SELECT p_partkey AS key, p_name || substr('⁄¥ƒ§', (p_partkey % 4 + 1)::INTEGER, 1) || '“ﬁß' AS standard, p_name || substr('˘ˇˆ˙˝˛˚˜', (p_partkey % 8 + 1)::INTEGER, 1) || '€é' AS pdfdoc FROM part")
def single_byte_encodings(s, d):
    def text(first: int, many: int, rest: str, encoding: str) -> Column:
        code = F.unhex(F.lpad(F.hex(F.lit(first) + F.col("p_partkey") % many), 2, "0"))
        return P.pdf_decode_text(F.concat(F.encode("p_name", "ISO-8859-1"), code, F.unhex(F.lit(rest))), F.lit(encoding))

    standard, pdfdoc = text(0xA4, 4, "AAAEFB", "StandardEncoding"), text(0x18, 8, "80E9", "PDFDocEncoding")
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), standard.alias("standard"), pdfdoc.alias("pdfdoc"))


@query("SELECT p_partkey AS key, p_name || '(' || p_brand || ')' || chr((65 + p_size % 26)::INTEGER) || chr(10) || p_type || 'z' AS text FROM part")
def string_escapes(s, d):
    octal = F.lpad(F.conv((F.lit(65) + F.col("p_size") % 26).cast("string"), 10, 8), 3, "0")
    raw = F.concat(F.col("p_name"), F.lit("\\("), F.col("p_brand"), F.lit("\\)\\"), octal, F.lit("\\n\\\n"), F.col("p_type"), F.lit("\\z"))
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), F.decode(P.pdf_unescape(F.encode(raw, "ISO-8859-1")), "ISO-8859-1").alias("text"))


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS text FROM orders")
def glyphs_by_standard_order(s, d):
    """A font file whose post table is of the first kind: glyphs are those of the standard order, in which a character of ASCII is 29 lower."""
    ascii_codes = [chr(c) for c in range(32, 127)]
    shown = F.translate("o_orderpriority", "".join(ascii_codes), "".join(chr(ord(c) - 29) for c in ascii_codes))
    font = "00010000" "0001" + "00" * 6 + b"post".hex() + "00000000" "0000001C" "00000020" "00010000" + "00" * 28
    more = F.lit(f"6 0 obj\n<< /Type /FontDescriptor /FontFile2 7 0 R >>\nendobj\n7 0 obj\n<< /Filter /ASCIIHexDecode /Length {len(font) + 1} >>\nstream\n{font}>\nendstream\nendobj\n")
    content = F.concat(F.lit("BT /F1 12 Tf <"), F.hex(F.encode(shown, "ISO-8859-1")), F.lit("> Tj ET"))
    files = _files(read(s, d, "orders"), "o_orderkey", one_page(content, font="/Type /Font /Subtype /TrueType /BaseFont /Any /FontDescriptor 6 0 R", more=more))
    return tables.document_text(files).select("doc_id", "text")


@query("SELECT p_partkey AS key, '[2.000 0.000 0.000 0.500 ' || printf('%.3f', p_size::DOUBLE) || ' ' || printf('%.3f', (p_partkey % 1000)::DOUBLE / 8) || ']' AS shown FROM part")
def matrix_display(s, d):
    m = B.matrix(2, 0, 0, 0.5, F.col("p_size"), F.col("p_partkey") % 1000 / 8)
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), m.alias("m")).select("key", B.matrix_string(F.col("m")).alias("shown"))


@query("SELECT p_partkey AS doc_id, (100 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END * p_size)::DOUBLE AS x, 200::DOUBLE AS y, 'F1' AS font_name, 9::DOUBLE AS font_size FROM part")
def malformed_operands(s, d):
    """A matrix with a name in it is passed by, a move takes 0 for one, and a font without a size keeps the size before it."""
    scale = F.when(F.col("p_partkey") % 2 == 0, F.lit("/a")).otherwise("2")
    content = F.concat(F.lit("/F0 9 Tf 1 0 0 1 100 200 cm "), scale, F.lit(" 0 0 1 0 0 cm BT /F1 Tf (b) Tc "), F.col("p_size").cast("string"), F.lit(" /x Td (Z) Tj ET"))
    out = tables.spans(_files(read(s, d, "part"), "p_partkey", one_page(content)))
    return out.select("doc_id", F.col("transform.e").cast("double").alias("x"), F.col("transform.f").cast("double").alias("y"), "font_name", F.col("font_size").cast("double").alias("font_size"))


@query("SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN '€' WHEN 1 THEN 'i' WHEN 2 THEN chr((256 + p_size)::INTEGER) ELSE NULL END AS shown FROM part")
def glyph_name_rules(s, d):
    code = F.lpad(F.hex(F.lit(256) + F.col("p_size")), 4, "0")
    name = F.element_at(F.array(F.lit("euro"), F.lit("idotaccent"), F.concat(F.lit("uni"), code, F.lit("0042")), F.concat(F.lit("uni"), F.substring(code, 1, 3))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), P.pdf_glyph_to_unicode(name).alias("shown"))


@query("SELECT p_partkey AS doc_id, (p_partkey % 2)::BIGINT AS pages FROM part")
def pages_without_a_catalogue(s, d):
    """Half of the documents name a catalogue that is a number; they have no pages, and that is no fault."""
    whole = one_page(F.lit("BT ET"))
    bare = F.encode(F.lit("%PDF-1.4\n1 0 obj\n7\nendobj\ntrailer\n<< /Root 1 0 R >>\n"), "ISO-8859-1")
    files = _files(read(s, d, "part"), "p_partkey", F.when(F.col("p_partkey") % 2 == 1, whole).otherwise(bare))
    pages = tables.pages(files).where("page_obj_id is not null").groupBy("doc_id").agg(F.count("*").alias("pages"))
    return files.select("doc_id").join(pages, "doc_id", "left").na.fill(0, ["pages"])


@query(f"SELECT doc_id, least(10, 3 + 2 * {_PAGES})::BIGINT AS objects, least({_PAGES}, 3)::BIGINT AS streams, TRUE AS measured FROM documents")
def memory_probe(s, d):
    out = metrics.memory_probe(_documents(s, d, per_page=LINES))
    return out.select("doc_id", "objects", "streams", ((F.col("rss_kb") > 0) & (F.col("grown_kb") >= 0) & (F.col("ms") >= 0)).alias("measured"))


@query(f"SELECT doc_id, (length(text) - {_N} + 1 > 0) AS has_text, TRUE AS passed, TRUE AS measured FROM documents")
def measured_loads(s, d):
    files = _documents(s, d)
    m = metrics.measured(files)
    text = tables.document_text(files, exact=True).select("doc_id", (F.length(F.regexp_replace("text", "\n", "")) > 0).alias("has_text"))
    return m.join(text, "doc_id").select("doc_id", "has_text", F.col("error").isNull().alias("passed"), ((F.col("rss_kb") > 0) & (F.col("ms") > 0) & (F.col("bytes") > 0)).alias("measured"))
