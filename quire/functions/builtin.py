"""Column functions made of Spark's own expressions: visible to Catalyst, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.encodings import TABLES

WHITE = "\\x00\\t\\n\\x0c\\r "
DELIMITERS = "()<>\\[\\]{}/%"
TEXT = "ISO-8859-1"


def latin1(raw: Column) -> Column:
    return F.decode(raw, TEXT)


def header_version(content: Column) -> Column:
    v = F.regexp_extract(latin1(F.substring(content, 1, 1024)), "(?s)%PDF-([^\\r\\n \\t]*)", 1)
    return F.when(F.instr(latin1(F.substring(content, 1, 1024)), "%PDF-") > 0, v).otherwise("Unknown")


def last_startxref(content: Column) -> Column:
    """What the last startxref of the last 2048 bytes says, null without one."""
    tail = latin1(F.substring(content, F.greatest(F.lit(1), F.length(content) - 2047), F.lit(2048)))
    return F.try_element_at(F.regexp_extract_all(tail, F.lit("startxref\\s+(\\d+)"), F.lit(1)), F.lit(-1)).cast("bigint")


def count_white(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{WHITE}]", ""))


def count_delimiters(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{DELIMITERS}]", ""))


def first_non_white(text: Column) -> Column:
    """Index of the first, or the length."""
    return F.length(F.regexp_extract(text, f"(?s)^[{WHITE}]*", 0))


def first_edge(text: Column) -> Column:
    """Index of the first white space or delimiter, or the length."""
    return F.length(F.regexp_extract(text, f"(?s)^[^{WHITE}{DELIMITERS}]*", 0))


def chunk_mask(text: Column, characters: str, size: int = 16) -> Column:
    """Bit mask of the characters in the first size of text, lowest bit first."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.substring(text, i + 1, F.lit(1)).rlike(f"^[{characters}]$"), F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bits), F.expr("0L"), lambda acc, b: acc * 2 + b)


def ascii_hex(text: Column) -> Column:
    """Bytes of an ASCIIHex string up to `>`; null if a character is no digit."""
    body = F.regexp_replace(F.regexp_extract(text, "(?s)^[^>]*", 0), f"[{WHITE}]", "")
    even = F.when(F.length(body) % 2 == 1, F.concat(body, F.lit("0"))).otherwise(body)
    return F.when(body.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def big_endian(raw: Column) -> Column:
    """A big-endian unsigned number of up to eight bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")


def decode_bytes(raw: Column, encoding: str = "WinAnsiEncoding") -> Column:
    """Text of a single-byte encoding, or of UTF-16 with a byte order mark."""
    table = TABLES[encoding]
    pairs = [(chr(i), c) for i, c in enumerate(table) if c != chr(i)]
    plain = F.translate(latin1(raw), "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else latin1(raw)
    mark, body = F.substring(raw, 1, 2), F.substring(raw, F.lit(3), F.length(raw))
    wide = F.when(mark == F.unhex(F.lit("FEFF")), F.decode(body, "UTF-16BE")).when(mark == F.unhex(F.lit("FFFE")), F.decode(body, "UTF-16LE"))
    return F.coalesce(wide, plain)


def object_key(dek: Column, obj_id: Column, gen: Column, aes: bool, size: int) -> Column:
    """Key of an object under revisions 2 to 4; size is the length of dek."""
    le = F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(0xFF)), 2, "0")) for v, n in ((obj_id, 3), (gen, 2)) for i in range(n)))
    salt = [F.unhex(F.lit("73416C54"))] if aes else []
    return F.substring(F.unhex(F.md5(F.concat(dek, le, *salt))), 1, 16 if aes else min(size + 5, 16))


def aes_cbc_decrypt(raw: Column, key: Column) -> Column:
    """Data with its IV in front; null if it can't be decrypted, empty if it is the IV alone."""
    return F.when(F.length(raw) == 16, F.unhex(F.lit(""))).otherwise(F.try_aes_decrypt(raw, key, F.lit("CBC"), F.lit("PKCS")))


# single-precision geometry over struct<a,b,c,d,e,f: float>
def matrix(a, b, c, d, e, f) -> Column:
    cols = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b, c, d, e, f))
    return F.struct(*(x.cast("float").alias(n) for x, n in zip(cols, "abcdef", strict=True)))


def multiply(m: Column, n: Column) -> Column:
    return F.struct(
        (m.a * n.a + m.b * n.c).alias("a"), (m.a * n.b + m.b * n.d).alias("b"), (m.c * n.a + m.d * n.c).alias("c"), (m.c * n.b + m.d * n.d).alias("d"),
        (m.e * n.a + m.f * n.c + n.e).alias("e"), (m.e * n.b + m.f * n.d + n.f).alias("f"),
    )


def transform_point(m: Column, x: Column, y: Column) -> Column:
    x, y = x.cast("float"), y.cast("float")
    return F.struct((x * m.a + y * m.c + m.e).alias("x"), (x * m.b + y * m.d + m.f).alias("y"))


def inverse(m: Column) -> Column:
    """Null where the determinant is 1e-12 or less."""
    det = m.a * m.d - m.b * m.c
    k = (F.lit(1.0).cast("float") / det).cast("float")
    parts = (m.d * k, -m.b * k, -m.c * k, m.a * k, (m.c * m.f - m.d * m.e) * k, (m.b * m.e - m.a * m.f) * k)
    return F.when(F.abs(det) > 1e-12, F.struct(*(p.cast("float").alias(n) for p, n in zip(parts, "abcdef", strict=True))))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in order; a NaN gives way."""
    side = lambda f, a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(f(a, b))
    x0, y0, x1, y1 = (v.cast("float") for v in (x0, y0, x1, y1))
    return F.struct(side(F.least, x0, x1).alias("min_x"), side(F.least, y0, y1).alias("min_y"), side(F.greatest, x0, x1).alias("max_x"), side(F.greatest, y0, y1).alias("max_y"))


def transform_rect(m: Column, r: Column) -> Column:
    """Bounds of the four corners."""
    corners = [transform_point(m, x, y) for x in (r.min_x, r.max_x) for y in (r.min_y, r.max_y)]
    xs, ys = [c.x for c in corners], [c.y for c in corners]
    return F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def matrix_string(m: Column) -> Column:
    return F.format_string("[%.3f %.3f %.3f %.3f %.3f %.3f]", m.a, m.b, m.c, m.d, m.e, m.f)


def default_width(ch: Column) -> Column:
    return F.when(ch.isin(*" .,:;!'|iljtfrI1"), 278.0).when(ch.isin(*"mwMW@%—"), 750.0).otherwise(500.0)


def font_style(name: Column) -> Column:
    low = F.lower(name)
    return F.struct(low.rlike("bold|black|heavy|demi").alias("is_bold"), low.rlike("italic|oblique|slanted").alias("is_italic"))


def real_string(x: Column) -> Column:
    """Five decimals at most, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.5f", x), "\\.?0+$", "")
