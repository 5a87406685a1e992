"""Known answers of the byte kernels, from the public specifications."""

from __future__ import annotations

import random

import pytest

from quire.kernel import aes, bytescan, ccitt, cmap, content, crypto, encodings, filters, fonts, geometry, glyphs, jbig2, lexer, parser, synth, textfold, writer, xref
from quire.kernel.base import Keyword, Name, PdfError, Ref, Stream
from quire.kernel.document import Document


def kind(f, *a):
    with pytest.raises(PdfError) as e:
        f(*a)
    return e.value.kind


def one(raw: bytes, **kw):
    return parser.parse_object(lexer.Lexer(raw), **kw)


def test_tokens():
    got = [(k, v) for _, k, v in lexer.tokens(b"true null -17 +3 3.5 .25 /Na#20me (a\\(b(c)\\101\\n) <48 65 6> [ ] << >> obj % c\n12")]
    assert got[:6] == [("bool", True), ("null", None), ("int", -17), ("int", 3), ("real", 3.5), ("real", 0.25)]
    assert got[6:9] == [("name", "Na#20me"), ("string", b"a(b(c)A\n"), ("hex_string", b"He`")]
    assert [k for k, _ in got[9:]] == ["array_start", "array_end", "dict_start", "dict_end", "keyword", "int"]


@pytest.mark.parametrize(("raw", "want"), [(b"1_0", Keyword(b"1_0")), (b"9223372036854775808", 9.223372036854775808e18), (b"5.", 5.0), (b"1e3", 1000.0), (b"--1", Keyword(b"--1"))])
def test_numbers_are_not_pythons(raw, want):
    assert lexer.Lexer(raw).next() == want


@pytest.mark.parametrize(("raw", "want"), [(b">", "SyntaxError"), (b"}", "SyntaxError"), (b"(abc", "UnterminatedString"), (b"<4x>", "InvalidHexString"), (b"/\xff", "SyntaxError")])
def test_token_faults(raw, want):
    assert lexer.tokens(raw)[-1][1:] == ("error", want)


def test_long_blanks_and_names():
    assert [v for _, _, v in lexer.tokens(b" " * 100 + b"/" + b"N" * 74)] == ["N" * 74]


def test_objects():
    v = one(b"<< /B 1 /A [1 0 R (x) null 2 0] /B 2 >>")
    assert v == {"A": [Ref(1, 0), b"x", None, 2, 0], "B": 2}
    assert list(v) == ["A", "B"]
    assert one(b"-1 0 R") == -1
    assert one(b"<</Length 3>>stream\r\nabc\nendstream") == Stream({"Length": 3}, b"abc")
    assert one(b"<</Length 99>>stream\nabc\r\nendstream").data == b"abc"
    assert kind(one, b"[" * 300) == "RecursionLimitExceeded"
    assert kind(one, b"[1") == "UnexpectedEof"


def test_operations():
    ops = list(content.operations(b"BT /F1 12 Tf (a) Tj [(b) -250 (c)] TJ 1 0 0 1 5 6 Tm (d) ' 1 2 (e) \" ET /P <</MCID 0>> BDC 7 8"))
    assert [o for o, _ in ops] == ["BT", "Tf", "Tj", "TJ", "Tm", "'", '"', "ET", "BDC"]
    assert ops[3][1] == [[b"b", -250, b"c"]]
    assert ops[8][1] == [Name("P"), {"MCID": 0}]
    assert len(content.OPERATOR_CLASS) == 73


def test_inline_image():
    ops = list(content.operations(b"BI /W 1 ID \x00\x01EIx\x02 EI Q"))
    assert ops[1][0] == "ID"
    assert ops[1][1][-1].data == b"\x00\x01EIx\x02"
    assert ops[2][0] == "Q"


def test_content_faults_end_the_iterator():
    out = []
    with pytest.raises(PdfError):
        for op in content.operations(b"q " + b"[" * 80 + b"]" * 80):
            out.append(op)
    assert out == [("q", [])]


def test_bytescan_agrees_with_a_scalar_loop():
    rnd = random.Random(1)
    for size in range(129):
        raw = bytes(rnd.choice(b"\x00\t\n\x0c\r ()<>[]{}/%abc\x0b\xff") for _ in range(size))
        assert bytescan.find_non_whitespace(raw) == next((i for i, b in enumerate(raw) if b not in b"\x00\t\n\x0c\r "), size)
        assert bytescan.find_delimiter_or_whitespace(raw) == next((i for i, b in enumerate(raw) if b in b"\x00\t\n\x0c\r ()<>[]{}/%"), size)
        white, delim = bytescan.chunk_masks(raw[:32])
        assert white == sum((b in b"\x00\t\n\x0c\r ") << i for i, b in enumerate(raw[:32]))
        assert delim == sum((b in b"()<>[]{}/%") << i for i, b in enumerate(raw[:32]))


def test_filters():
    assert filters.ascii_hex(b"48 65 6c6c6f7>") == b"Hellop"
    assert filters.ascii85(b"87cURD]j7BEbo80~>") == b"Hello world!"
    assert filters.ascii85(b"z~>") == b"\0\0\0\0"
    assert kind(filters.ascii85, b"ab z~>"[:3] + b"z~>") == "SyntaxError"
    assert kind(filters.ascii_hex, b"4x>") == "InvalidHexString"
    assert kind(filters.flate, b"not zlib") == "Io"
    assert kind(filters.flate, __import__("zlib").compress(b"x" * 1000)[:-6]) == "Io"
    assert kind(filters.decode, b"", [("LZWDecode", {})]) == "UnsupportedFilter"
    raw = bytes(range(256)) * 3
    for spec in ("Fl", "A85 Fl", "AHx A85 Fl"):
        assert filters.decode(synth.encode(raw, spec.split()), [(n, {}) for n in spec.split()]) == raw


def test_flate_bomb():
    import zlib

    d = zlib.compressobj(9)
    raw = b"".join([d.compress(bytes(1 << 20)) for _ in range(257)] + [d.flush()])
    assert kind(filters.flate, raw) == "Unsupported"


@pytest.mark.parametrize("tag", [0, 1, 2, 3, 4])
def test_png_predictors(tag):
    rnd = random.Random(tag)
    rows = [bytes(rnd.randrange(256) for _ in range(9)) for _ in range(5)]
    bpp, above, coded = 3, bytes(9), b""
    for r in rows:
        line = []
        for i, x in enumerate(r):
            a, b, c = (r[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[tag]) & 255)
        coded += bytes([tag, *line])
        above = r
    assert filters.unpredict(coded, 15, 3, 3) == b"".join(rows)


def test_tiff_predictor():
    assert filters.unpredict(bytes([1, 2, 255, 5, 1, 1]), 2, 3) == bytes([1, 3, 2, 5, 6, 7])


@pytest.mark.parametrize(
    ("k", "rows", "black", "raw", "want"),
    [(-1, 2, True, "C0040040", "0000"), (-1, 1, True, "36C0", "0F"), (-1, 1, False, "36C0", "F0"), (-1, 2, True, "36DC", "0F07"), (0, 1, True, "98", "00")],
)
def test_ccitt(k, rows, black, raw, want):
    p = ccitt.CcittParams(k=k, columns=8, rows=rows, black_is_1=black)
    assert ccitt.decode_ccitt(bytes.fromhex(raw), p).hex().upper() == want


def test_ccitt_against_an_encoder():
    rnd = random.Random(3)
    white = {v: f"{c:0{n}b}" for (n, c), v in ccitt.WHITE_RUNS.items()}
    black = {v: f"{c:0{n}b}" for (n, c), v in ccitt.BLACK_RUNS.items()}
    assert len(white) == len(black) == 104

    def run(n, table):
        out = ""
        while n >= 2560 + 64:
            out, n = out + table[2560], n - 2560
        return out + (table[n // 64 * 64] if n >= 64 else "") + table[n % 64]

    for columns in (1, 7, 64, 200, 2700):
        bits, want = "", b""
        for _ in range(3):
            at, dark, row = 0, False, ""
            while at < columns:
                n = min(columns - at, rnd.choice([0, 1, 5, 63, 64, 65, 1000, 2600])) if at else min(columns, rnd.choice([0, 3, 70]))
                if not n and at:
                    n = 1
                bits += run(n, black if dark else white)
                row += ("1" if dark else "0") * n
                at, dark = at + n, not dark
            size = (columns + 7) // 8
            want += int(row.ljust(size * 8, "0"), 2).to_bytes(size, "big")
        raw = int(bits.ljust((len(bits) + 7) // 8 * 8, "0"), 2).to_bytes((len(bits) + 7) // 8, "big")
        assert ccitt.decode_ccitt(raw, ccitt.CcittParams(k=0, columns=columns, rows=3, black_is_1=True)) == want


def test_ccitt_limits():
    assert kind(ccitt.decode_ccitt, b"\0", ccitt.CcittParams(k=-1, columns=1 << 20, rows=2_000_000)) == "Unsupported"


def test_jbig2():
    page = bytes(4) + b"\x30\0\x01" + (19).to_bytes(4, "big") + (64).to_bytes(4, "big") + (32).to_bytes(4, "big") + bytes(11)
    region = b"\0\0\0\1\x26\0\x01" + (21).to_bytes(4, "big") + bytes(17) + b"abcd"
    assert len(jbig2.segments(page + region)) == 2
    assert jbig2.decode_jbig2(page + region) == b"abcd".ljust(256, b"\0")
    assert jbig2.decode_jbig2(b"junk") == b"junk"


@pytest.mark.parametrize(("key", "plain", "want"), [(b"Key", b"Plaintext", "BBF316E8D940AF0AD3"), (b"Wiki", b"pedia", "1021BF0420"), (b"Secret", b"Attack at dawn", "45A01F645FC35B383552544B9BF5")])
def test_rc4(key, plain, want):
    assert crypto.rc4(plain, key).hex().upper() == want
    assert crypto.rc4(crypto.rc4(plain, key), key) == plain


def test_aes_known_answers():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        coded = aes.cbc_encrypt_raw(plain, bytes(range(n)), bytes(16))
        assert coded.hex() == want
        assert aes.cbc_decrypt_raw(coded, bytes(range(n)), bytes(16)) == plain
    assert aes.cbc_decrypt(aes.cbc_encrypt(b"abc", bytes(32), bytes(16)), bytes(32)) == b"abc"
    assert aes.cbc_decrypt(bytes(16), bytes(16)) == b""
    assert kind(aes.cbc_decrypt, bytes(17), bytes(16)) == "Decryption"


def test_security_faults():
    base = {"Filter": Name("Standard"), "V": 2, "R": 3, "P": -4, "O": bytes(32), "U": bytes(32), "Length": 128}
    for change in ({"R": 1}, {"Length": 500}, {"Length": 44}, {"V": 3}, {"V": 4, "R": 4, "Length": 256}, {"O": None}, {"Filter": Name("Other")}):
        assert kind(crypto.handler, base | change, b"", b"") == "Decryption"


@pytest.mark.parametrize("cipher", ["rc4_40", "rc4_128", "aes128", "aes256_r5", "aes256_r6"])
def test_encrypted_documents(cipher):
    raw = synth.build("geheim\nzwei", cipher=cipher, password=b"user", seed=b"s")
    d = Document.load(raw, b"user")
    assert d.page_text(d.page_ids()[0]) == "geheim\nzwei"
    assert kind(Document.load, raw, b"no") == "Decryption"
    if not cipher.startswith("aes256"):
        assert Document.load(raw, b"owner").page_text(4) == "geheim\nzwei"


def test_encodings():
    assert encodings.decode_text(b"\x80\x20\x99") == "€ ™"
    assert encodings.decode_text(b"\x80\x81\x82", "MacRomanEncoding") == "ÄÅÇ"
    assert encodings.decode_text(b"\xa2\xa3'`", "StandardEncoding") == "¢£'`"
    assert encodings.decode_text(bytes.fromhex("FEFF004800690021")) == "Hi!"
    assert encodings.decode_text(b"\xff\xfeH\0i\0x") == "Hi"
    assert encodings.utf16(b"\xd8\x00\0A", True) == "�A"
    assert encodings.decode_text(b"\xef\xbb\xbf\xc3\xa9") == "é"
    assert encodings.encoding_name("Identity-H") == "WinAnsiEncoding"


def test_cmap():
    m = cmap.CMap.parse(b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfchar <41> <00660069> <8001> <D83DDE00> endbfchar 2 beginbfrange <8010> <8012> <4E2D> <42> <43> [<0058> <0059>] endbfrange")
    assert m.decode(b"A\x80\x01\x80\x11BCz") == "fi😀丮XYz"
    assert m.lookup_char(0x42) == "X" and len(m) == 7
    two = cmap.CMap.parse(b"beginbfrange <0041> <0043> <0061> endbfrange")
    assert two.decode(b"\0A\0B\0C") == "abc"
    assert len(cmap.CMap.parse(b"beginbfrange <00000000> <FFFFFFFF> <0041> endbfrange beginbfchar <zz")) == 0


def test_glyph_names():
    assert [glyphs.glyph_to_char(n) for n in ("A", "fi", "Euro", "uni20AC", "u1F600", "a.alt", "uniD800", ".notdef", "")] == ["A", "ﬁ", "€", "€", "😀", "a", None, None, None]
    assert [glyphs.glyph_to_char(n) for n in ("euro", "idotaccent", "uni00410042", "uni0041.alt", "uni004", "uni00G10042")] == ["€", "i", "A", "A", None, None]
    assert len(glyphs.MAC_ORDER) == 258 and len(glyphs.CFF_STRINGS) == 391
    assert glyphs.MAC_ORDER[36] == "A" and glyphs.MAC_ORDER[257] == "dcroat" and glyphs.CFF_STRINGS[34] == "A" and glyphs.CFF_STRINGS[390] == "Semibold"


def test_fonts():
    assert fonts.truetype(synth.truetype_font({1: "x", 2: "é"})).glyphs == {1: "x", 2: "é"}
    assert fonts.cff(synth.cff_font({1: "x", 2: "é"})).glyphs == {1: "x", 2: "é"}
    assert kind(fonts.truetype, b"\0\1") == "UnexpectedEof"
    assert kind(fonts.cff, b"\1\0\4\2\0") == "UnexpectedEof"
    four = (4).to_bytes(2, "big") + b"\0\x20\0\0" + (4).to_bytes(2, "big") + bytes(6) + b"\0\x42\xff\xff\0\0\0\x41\xff\xff\xff\xc3\0\1\0\0\0\0"
    table = b"\0\0\0\1\0\3\0\1" + (12).to_bytes(4, "big") + four
    font = b"\0\1\0\0\0\1" + bytes(6) + b"cmap" + bytes(4) + (28).to_bytes(4, "big") + len(table).to_bytes(4, "big") + table
    assert fonts.truetype(font).codes == {0x41: "A", 0x42: "B"} and fonts.truetype(font).glyphs == {4: "A", 5: "B"}


def test_geometry():
    m = geometry.multiply(geometry.scaling(2, 2), geometry.translation(50, 100))
    assert geometry.point(m, 10, 20) == (70, 140)
    assert geometry.point(geometry.inverse(m), 70, 140) == (10, 20)
    assert geometry.inverse((1, 1, 1, 1, 0, 0)) is None
    assert geometry.bounds((0, 1, -1, 0, 0, 0), geometry.rect(4, 3, 0, 0)) == (-3, 0, 0, 4)
    assert geometry.rect(float("nan"), 0, 1, 1)[0] == 1


def test_spans():
    ops = content.operations(b"q 2 0 0 2 50 100 cm BT /F 10 Tf 14 TL 10 20 Td (ab) Tj T* (cd) Tj ET Q BT /Bold 10 Tf 150 Tz [(a) -250 (b)] TJ ET")
    s = geometry.Tracker().run(ops)
    assert [(x[0], x[6][4:]) for x in s] == [("ab", (70, 140)), ("cd", (70, 112)), ("a b", (0, 0))]
    assert s[2][4] and not s[0][4]
    assert s[2][1][2] == pytest.approx((5 + 5 + 2.5) * 1.5)
    deep = geometry.Tracker()
    deep.run(content.operations(b"q " * 500))
    assert len(deep.stack) == geometry.STACK


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"BT (a) Tj ET BT (b) Tj ET", "a b"), (b"BT [(Hello) -250 (TJ) 100 (x)] TJ ET", "Hello TJx"), (b"BT (a) Tj 0 -14 Td (b) Tj 5 0 Td (c) Tj 1 0 Td (d) Tj ET", "a\nb cd"),
        (b"BT 1 0 0 1 0 700 Tm (a) Tj 1 0 0 1 50 700 Tm (b) Tj 1 0 0 1 50 680 Tm (c) Tj ET", "a b\nc"), (b"BT (a ) Tj ( b) Tj T* T* (c) ' ET", "a b\nc"), (b"(x) Tj", "x"),
    ],
)
def test_text_rules(raw, want):
    assert textfold.extract(content.operations(raw)) == want


LAYOUTS = [{}, {"layout": "packed"}, {"layout": "packed12"}, {"layout": "severed"}, {"filters": "A85 Fl"}, {"filters": "AHx"}, {"font": "macroman"}, {"font": "tounicode"}, {"font": "truetype"}, {"font": "cff"}, {"per_page": 1}, {"kern": -250}]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_round_trips(layout):
    text = "Hello (World) \\ back\nzweite Zeile äöü é\nthird"
    d = Document.load(synth.build(text, **layout))
    assert "\n".join(map(d.page_text, d.page_ids())) == text
    again, skipped = writer.pack(d)
    p = Document.load(again)
    assert "\n".join(map(p.page_text, p.page_ids())) == text and p.xref_kind() == "stream" and not skipped
    assert d.xref.recovered == (layout.get("layout") == "severed")


def test_revisions():
    raw = synth.with_revision("old", "new")
    assert Document.load(raw).page_text(4) == "new"
    assert Document.load(raw, merge="overwrite").page_text(4) == "old"


def test_strict_and_recovery():
    raw = synth.build("x", layout="severed")
    assert kind(lambda: Document.load(raw, strict=True)) == "SyntaxError"
    assert Document.load(raw).object_count() == 5
    assert kind(Document.load, b"nothing here") == "RecoveryFailed"
    assert xref.repair(b"1 0 obj\n<</Type /Catalog>>\nendobj").trailer["Root"] == Ref(1, 0)
    assert xref.repair(b"1 1 obj 5 endobj").entries == {1: ("n", 0, 1)}


def hand_made(*objects: bytes, root: int = 1) -> bytes:
    return b"%PDF-1.4\n" + b"\n".join(objects) + b"\ntrailer <</Root %d 0 R>>" % root


def test_cycles_end():
    kids = hand_made(b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj", b"3 0 obj <</Type /Pages /Kids [2 0 R 3 0 R]>> endobj")
    assert Document.load(kids).page_ids() == []
    loop = hand_made(b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj", b"3 0 obj <</Type /Page /Contents 10 0 R>> endobj", b"10 0 obj 10 0 R endobj")
    assert kind(Document.load(loop).page_text, 3) == "CyclicReference"
    d = Document.load(hand_made(b"1 0 obj <<>> endobj"))
    d.xref.entries |= {10: ("c", 10, 0), 20: ("c", 21, 0), 21: ("c", 22, 0)}
    assert kind(d.object, 10) == "CyclicReference"
    assert kind(d.object, 20) == "Unsupported"
    assert d.object(99) is None


def test_writer():
    assert [writer.real(x) for x in (0.0, 1.5, -2.25, 1e-7, 100.0)] == [b"0", b"1.5", b"-2.25", b"0", b"100"]
    assert writer.dump({"B": b"a(b)\\", "A": [Name("N"), None, True, Ref(3, 0)]}) == b"<<\n/A [/N null true 3 0 R]\n/B (a\\(b\\)\\\\)\n>>"
    gap = writer.write_classic({1: {"Type": Name("Catalog")}, 7: 5}, {"Root": Ref(1, 0)})
    assert Document.load(gap, strict=True).object(7) == 5


def test_mutations_never_break_out():
    rnd = random.Random(5)
    raws = [synth.build("alpha beta\ngamma", **o) for o in ({}, {"layout": "packed12"}, {"font": "truetype"})]
    for n in range(300):
        raw = bytearray(raws[n % 3])
        for _ in range(rnd.randrange(1, 8)):
            raw[rnd.randrange(len(raw))] = rnd.randrange(256)
        raw = bytes(raw[: rnd.randrange(len(raw))] if n % 2 else raw)
        try:
            d = Document.load(raw)
            for p in d.page_ids():
                d.page_text(p), d.page_spans(p)
        except PdfError:
            pass


def test_large_file():
    raw = synth.large(2)
    d = Document.load(raw, strict=True)
    assert len(raw) > 2 << 20 and d.object_count() == 4 and len(d.object(3).data) == 2 << 20 and d.page_ids() == []


def test_operands_that_are_no_numbers():
    t = geometry.Tracker()
    ops = [("cm", [2, 0, 0, 2, Name("x"), 6]), ("cm", [2, 0, 0, 2, 5]), ("Tf", [Name("F1"), 9]), ("Tf", [Name("F2")]), ("Tf", [Name("F3"), b"x"]), ("Tc", [b"x"]), ("TL", [14]), ("TL", [Name("y")]), ("Tz", [])]
    assert t.run(ops) == [] and t.ctm == geometry.IDENTITY and (t.font, t.size, t.leading, t.scale) == ("F3", 9.0, 14.0, 100.0)
    t.run([("BT", []), ("Tm", [1, 0, 0, 1, 5, b"y"]), ("Td", [3]), ("Td", [Name("x"), 4])])
    assert t.tm[4:] == (3.0, 4.0)
    t.run([("TD", [1, Name("x")])])
    assert t.tm[4:] == (4.0, 4.0) and t.leading == 0
    (span,) = t.run([('"', [Name("x"), 2, b"z"])])
    assert span[0] == "z" and (t.word_space, t.char_space) == (0.0, 2.0)


def test_documents_without_a_catalogue_have_no_pages():
    for root in (b"", b"/Root 7", b"/Root 1 0 R", b"/Root 9 0 R"):
        d = Document.load(b"%PDF-1.4\n1 0 obj\n7\nendobj\n2 0 obj\n<< /A 1 >>\nendobj\nxref\n0 3\n0000000000 65535 f \n0000000009 00000 n \n0000000026 00000 n \ntrailer\n<< /Size 3 " + root + b" >>\nstartxref\n59\n%%EOF\n")
        assert d.page_ids() == []
