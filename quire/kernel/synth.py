"""Deterministic PDFs from text: the corpus that queries and tests run over, since the tables hold no PDF."""

from __future__ import annotations

import hashlib
import zlib
from codecs import charmap_decode

from . import crypto, encodings
from .aes import cbc_encrypt, cbc_encrypt_raw
from .base import Name, Ref, Stream
from .filters import ascii85_encode
from .writer import Serializer, dump, write_classic, write_packed

LEADING = 14
_FILTERS = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode"}


def literal(raw: bytes) -> bytes:
    return dump(raw)


def encode(raw: bytes, filters: list[str]) -> bytes:
    """raw so that the filters, left to right, give it back."""
    for f in reversed(filters):
        f = _FILTERS.get(f, f)
        if f == "FlateDecode":
            raw = zlib.compress(raw, 6)
        elif f == "ASCIIHexDecode":
            raw = raw.hex().upper().encode() + b">"
        elif f == "ASCII85Decode":
            raw = ascii85_encode(raw) + b"~>"
    return raw


def text_lines(lines: list[bytes]) -> bytes:
    """Lines shown one under another."""
    head = b"BT\n/F1 12 Tf\n%d TL\n72 720 Td\n" % LEADING
    return head + b"\nT*\n".join(literal(s) + b" Tj" for s in lines) + b"\nET\n"


def kerned_lines(lines: list[list[bytes]], kern: int) -> bytes:
    """Words of a line apart by a kern instead of a space."""
    shown = [b"[" + (b" %d " % kern).join(literal(w) for w in words) + b"] TJ" for words in lines]
    return b"BT\n/F1 12 Tf\n%d TL\n72 720 Td\n" % LEADING + b"\nT*\n".join(shown) + b"\nET\n"


def to_unicode(codes: dict[int, str], size: int = 2) -> bytes:
    rows = [b"<%0*X> <%s>" % (2 * size, c, t.encode("utf-16-be").hex().upper().encode()) for c, t in sorted(codes.items())]
    parts = [b"/CIDInit /ProcSet findresource begin\n1 begincodespacerange\n<" + b"00" * size + b"> <" + b"FF" * size + b">\nendcodespacerange\n"]
    for i in range(0, len(rows), 100):
        part = rows[i : i + 100]
        parts.append(b"%d beginbfchar\n" % len(part) + b"\n".join(part) + b"\nendbfchar\n")
    return b"".join(parts)


def truetype_font(glyphs: dict[int, str]) -> bytes:
    """A font whose post table names its glyphs uniXXXX."""
    n = max(glyphs, default=0) + 1
    names, index = b"", []
    for gid in range(n):
        ch = glyphs.get(gid)
        if ch is None:
            index.append(0)
        else:
            index.append(258 + len([i for i in index if i >= 258]))
            names += b"\x07uni%04X" % ord(ch)
    post = (0x00020000).to_bytes(4, "big") + bytes(28) + n.to_bytes(2, "big") + b"".join(i.to_bytes(2, "big") for i in index) + names
    head = b"\0\1\0\0" + (1).to_bytes(2, "big") + bytes(6)
    return head + b"post" + bytes(4) + (28).to_bytes(4, "big") + len(post).to_bytes(4, "big") + post


def cff_font(glyphs: dict[int, str]) -> bytes:
    """A font whose charset names its glyphs by strings of its own."""

    def index(items: list[bytes]) -> bytes:
        if not items:
            return b"\0\0"
        ends, at = [1], 1
        for i in items:
            at += len(i)
            ends.append(at)
        return len(items).to_bytes(2, "big") + b"\2" + b"".join(e.to_bytes(2, "big") for e in ends) + b"".join(items)

    n = max(glyphs, default=0) + 1
    strings = [b"uni%04X" % ord(glyphs[g]) if g in glyphs else b".notdef" for g in range(1, n)]
    num = lambda v: b"\x1d" + v.to_bytes(4, "big")
    front = b"\1\0\4\2" + index([b"F"])
    middle = index(strings) + index([])
    size = len(index([num(0) + b"\x0f" + num(0) + b"\x11"]))
    charset_at = len(front) + size + len(middle)
    charset = b"\0" + b"".join((391 + i).to_bytes(2, "big") for i in range(n - 1))
    chars_at = charset_at + len(charset)
    return front + index([num(charset_at) + b"\x0f" + num(chars_at) + b"\x11"]) + middle + charset + index([b"\x0e"] * n)


def font_dict(kind: str, chars: str = "") -> tuple[dict, dict[int, object], dict[str, bytes]]:
    """A font, its further objects (numbers from 100) and the code of each character; kind names an encoding or a font type."""
    base = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    if kind in ("winansi", "macroman", "standard", "pdfdoc"):
        name = {"winansi": "WinAnsiEncoding", "macroman": "MacRomanEncoding", "standard": "StandardEncoding", "pdfdoc": "PDFDocEncoding"}[kind]
        return base | {"Encoding": Name(name)}, {}, {}
    unique = sorted(set(chars))
    codes = {c: i + 1 for i, c in enumerate(unique)}
    if kind == "tounicode":
        size = 2 if len(unique) < 65536 else 3
        wide = {c: i.to_bytes(size, "big") for c, i in codes.items()}
        font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Any"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(100, 0)}
        return font, {100: Stream({"Filter": Name("FlateDecode")}, zlib.compress(to_unicode({i: c for c, i in codes.items()}, size)))}, wide
    one = {c: bytes([i]) for c, i in codes.items() if i < 256}
    glyphs = {i: c for c, i in codes.items() if i < 256}
    body, key = (truetype_font(glyphs), "FontFile2") if kind == "truetype" else (cff_font(glyphs), "FontFile3")
    desc = {"Type": Name("FontDescriptor"), key: Ref(101, 0)}
    return base | {"FontDescriptor": Ref(100, 0)}, {100: desc, 101: Stream({}, body)}, one


def objects(contents: list[bytes], font: dict, extra: dict[int, object] | None = None, filters: list[str] | None = None) -> dict[int, object]:
    """1 catalogue, 2 pages, 3 font, then a page and its contents in turn; further objects are renumbered after them."""
    filters = filters or []
    at = 4 + 2 * len(contents)
    moved = {n: at + i for i, n in enumerate(sorted(extra or {}))}

    def renumber(v):
        if isinstance(v, Ref):
            return Ref(moved.get(v.id, v.id), v.gen)
        if isinstance(v, dict):
            return {k: renumber(x) for k, x in v.items()}
        return v

    out: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    out[2] = {"Type": Name("Pages"), "Count": len(contents), "Kids": [Ref(4 + 2 * i, 0) for i in range(len(contents))]}
    out[3] = renumber(font)
    for i, body in enumerate(contents):
        page = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3, 0)}}, "Contents": Ref(5 + 2 * i, 0)}
        names = [Name(_FILTERS.get(f, f)) for f in filters]
        d = {} if not names else {"Filter": names[0] if len(names) == 1 else names}
        out[4 + 2 * i], out[5 + 2 * i] = page, Stream(d, encode(body, filters))
    for n, v in (extra or {}).items():
        out[moved[n]] = renumber(v)
    return out


def encrypted(objs: dict[int, object], scheme: str, password: bytes, seed: bytes) -> tuple[dict[int, object], dict]:
    """objs under the standard handler, and the trailer's entries. scheme: rc4_40, rc4_128, aes128, aes256_r5 or aes256_r6."""
    id0 = hashlib.md5(seed).digest()
    rand = lambda label, n: hashlib.sha256(seed + label).digest()[:n]
    d: dict = {"Filter": Name("Standard"), "P": -4}
    if scheme.startswith("aes256"):
        r = int(scheme[-1])
        key, uv, uk, ov, ok = rand(b"key", 32), rand(b"uv", 8), rand(b"uk", 8), rand(b"ov", 8), rand(b"ok", 8)
        h = (lambda salt, extra=b"": crypto.hash_r6(password, salt, extra)) if r == 6 else (lambda salt, extra=b"": hashlib.sha256(password + salt + extra).digest())
        u = h(uv) + uv + uk
        o = h(ov, u) + ov + ok
        d |= {"V": 5, "R": r, "Length": 256, "U": u, "O": o, "UE": cbc_encrypt_raw(key, h(uk), bytes(16)), "OE": cbc_encrypt_raw(key, h(ok, u), bytes(16))}
        handler = crypto.Handler(5, r, 32, "aes256", "aes256", True, -4, key)
    else:
        v, r, size = {"rc4_40": (1, 2, 5), "rc4_128": (2, 3, 16), "aes128": (4, 4, 16)}[scheme]
        o = crypto.owner_entry(b"owner", password, r, size)
        key = crypto.derive_key(password, o, -4, id0, r, size)
        d |= {"V": v, "R": r, "Length": size * 8, "O": o, "U": crypto.user_entry(key, id0, r)}
        if v == 4:
            d |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        cipher = "aes128" if v == 4 else "rc4"
        handler = crypto.Handler(v, r, size, cipher, cipher, True, -4, key)

    def cover(raw: bytes, n: int) -> bytes:
        if handler.stream_cipher == "rc4":
            return crypto.rc4(raw, handler.object_key(n, 0, False))
        k = handler.dek if handler.stream_cipher == "aes256" else handler.object_key(n, 0, True)
        return cbc_encrypt(raw, k, rand(b"iv%d" % n, 16))

    def hide(v, n: int):
        if isinstance(v, bytes):
            return cover(v, n)
        if isinstance(v, list):
            return [hide(x, n) for x in v]
        if isinstance(v, dict):
            return {k: hide(x, n) for k, x in v.items()}
        if isinstance(v, Stream):
            return Stream(hide(v.dict, n), cover(v.data, n))
        return v

    out = {n: hide(v, n) for n, v in objs.items()}
    at = max(out) + 1
    out[at] = d
    return out, {"Encrypt": Ref(at, 0), "ID": [id0, id0]}


def shows(text: str, font: str) -> bool:
    """Whether a font of that kind has a code for each character of text, none read back as another and no byte order mark among them."""
    if font in ("truetype", "cff"):
        return len(set(text) - {"\n"}) < 256 and max(text, default="") < "\U00010000"
    if font not in ("winansi", "macroman"):
        return True
    name, table = ("cp1252", encodings.WINANSI) if font == "winansi" else ("mac_roman", encodings.MACROMAN)
    try:
        raw = text.encode(name)
    except UnicodeEncodeError:
        return False
    return not any(mark in raw for mark in (b"\xfe\xff", b"\xff\xfe", b"\xef\xbb\xbf")) and charmap_decode(raw, "strict", table)[0] == text


def build(text: str, layout: str = "table", filters: str = "", font: str = "winansi", per_page: int = 0, kern: int | None = None, cipher: str = "", password: bytes = b"", seed: bytes = b"") -> bytes:
    """A PDF that shows text, line by line.

    layout: table, packed (object stream and cross-reference stream), packed12 (with a PNG predictor), severed (no table
    or trailer). filters: names separated by spaces. font: see font_dict; a text that it cannot show has a ToUnicode font. per_page: lines a page, 0 for one page.
    """
    font = font if shows(text, font) else "tounicode"
    lines = text.split("\n")
    chunks = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] if per_page else [lines]
    d, extra, codes = font_dict(font, text.replace("\n", ""))

    def code(s: str) -> bytes:
        if codes:
            return b"".join(codes[c] for c in s)
        return s.encode({"macroman": "mac_roman"}.get(font, "cp1252" if font == "winansi" else "latin-1"))

    def show(ls: list[str]) -> bytes:
        return text_lines([code(s) for s in ls]) if kern is None else kerned_lines([[code(w) for w in s.split(" ")] for s in ls], kern)

    objs = objects([show(c) for c in chunks], d, extra, filters.split())
    trailer: dict = {"Root": Ref(1, 0)}
    if cipher:
        objs, more = encrypted(objs, cipher, password, seed)
        trailer |= more
    if layout.startswith("packed"):
        return write_packed(objs, trailer, 12 if layout == "packed12" else 1)
    raw = write_classic(objs, trailer)
    return raw[: raw.rindex(b"xref\n0 ")] if layout == "severed" else raw


def with_revision(first: str, second: str) -> bytes:
    """A document that showed first and was changed to second by an appended section."""
    raw = build(first)
    at = raw.rindex(b"startxref\n") + 10
    prev = int(raw[at : raw.index(b"\n", at)])
    out = Serializer()
    out.write(raw)
    where = out.indirect(5, 0, Stream({}, text_lines([s.encode("cp1252") for s in second.split("\n")])))
    start = out.written
    out.write(b"xref\n5 1\n%010d 00000 n \ntrailer\n" % where + dump({"Root": Ref(1, 0), "Size": 6, "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
    return out.value()


def large(mebibytes: int) -> bytes:
    """One stream of the letter A of so many MiB and a classic table."""
    return write_classic({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Count": 0, "Kids": []}, 3: Stream({}, b"A" * (mebibytes << 20))}, {"Root": Ref(1, 0)})
