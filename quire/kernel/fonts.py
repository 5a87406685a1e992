"""Characters of the glyphs and codes of embedded TrueType and CFF fonts."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .base import PdfError
from .cmap import CMap
from .glyphs import CFF_STRINGS, MAC_ORDER, glyph_to_char


@dataclass
class Font:
    glyphs: dict[int, str] = field(default_factory=dict)
    codes: dict[int, str] = field(default_factory=dict)

    def glyph(self, gid: int) -> str | None:
        return self.glyphs.get(gid)

    def to_cmap(self) -> CMap:
        """Glyphs first, then codes over them."""
        return CMap(self.glyphs | self.codes)


def _get(data: bytes, at: int, form: str):
    size = struct.calcsize(form)
    if at < 0 or at + size > len(data):
        raise PdfError("UnexpectedEof", "font is truncated", at)
    return struct.unpack_from(form, data, at)


def _char(code: int) -> str | None:
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code < 0x110000 else None


def truetype(data: bytes) -> Font:
    n = _get(data, 4, ">H")[0]
    tables = {}
    for i in range(n):
        tag, _, at, size = _get(data, 12 + 16 * i, ">4sIII")
        if at + size <= len(data):
            tables[tag] = data[at : at + size]
    font = Font()
    if b"cmap" in tables:
        _cmap(tables[b"cmap"], font)
    if b"post" in tables:
        _post(tables[b"post"], font)
    return font


def _cmap(t: bytes, font: Font) -> None:
    found: dict[int, int] = {}
    for i in range(_get(t, 2, ">H")[0]):
        try:
            at = _get(t, 4 + 8 * i, ">HHI")[2]
            found.setdefault(_get(t, at, ">H")[0], at)
        except PdfError:
            break
    if 12 in found:
        at = found[12]
        for i in range(min(_get(t, at + 12, ">I")[0], 65536)):
            try:
                first, last, gid = _get(t, at + 16 + 12 * i, ">III")
            except PdfError:
                break
            if last < first or last - first > 65536:
                continue
            for code in range(first, last + 1):
                if (c := _char(code)) is not None:
                    g = (gid + code - first) & 0xFFFF
                    font.codes[code] = c
                    font.glyphs[g] = c
    if 4 in found:
        at = found[4]
        n = _get(t, at + 6, ">H")[0] // 2
        for i in range(n):
            try:
                end, start = _get(t, at + 14 + 2 * i, ">H")[0], _get(t, at + 16 + 2 * n + 2 * i, ">H")[0]
                delta, where = _get(t, at + 16 + 4 * n + 2 * i, ">H")[0], at + 16 + 6 * n + 2 * i
                shift = _get(t, where, ">H")[0]
            except PdfError:
                break
            for code in range(start, min(end, 0xFFFE) + 1):
                gid = (code + delta) & 0xFFFF
                if shift:
                    try:
                        gid = _get(t, where + shift + 2 * (code - start), ">H")[0]
                    except PdfError:
                        break
                    gid = (gid + delta) & 0xFFFF if gid else 0
                if gid and (c := _char(code)) is not None:
                    font.codes.setdefault(code, c)
                    font.glyphs.setdefault(gid, c)


def _post(t: bytes, font: Font) -> None:
    version = _get(t, 0, ">I")[0]
    if version == 0x00010000:
        for gid, name in enumerate(MAC_ORDER):
            if (c := glyph_to_char(name)) is not None:
                font.glyphs.setdefault(gid, c)
    elif version == 0x00020000:
        n = _get(t, 32, ">H")[0]
        index = [_get(t, 34 + 2 * i, ">H")[0] for i in range(n) if 36 + 2 * i <= len(t)]
        names, at = [], 34 + 2 * n
        while at < len(t):
            size = t[at]
            names.append(t[at + 1 : at + 1 + size].decode("latin-1"))
            at += 1 + size
        for gid, i in enumerate(index):
            name = MAC_ORDER[i] if i < 258 else names[i - 258] if i - 258 < len(names) else None
            if (c := glyph_to_char(name)) is not None:
                font.glyphs[gid] = c


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Items of an INDEX, and where it ends."""
    n = _get(data, at, ">H")[0]
    if not n:
        return [], at + 2
    size = _get(data, at + 2, "B")[0]
    if not 1 <= size <= 4:
        raise PdfError("SyntaxError", "bad CFF offset size", at)
    if at + 3 + (n + 1) * size > len(data):
        raise PdfError("UnexpectedEof", "CFF index is truncated", at)
    ends = [int.from_bytes(data[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(n + 1)]
    base = at + 2 + (n + 1) * size
    if ends[0] != 1 or any(a > z for a, z in zip(ends, ends[1:], strict=False)) or base + ends[-1] > len(data):
        raise PdfError("SyntaxError", "bad CFF index", at)
    return [data[base + a : base + z] for a, z in zip(ends, ends[1:], strict=False)], base + ends[-1]


def cff_dict(data: bytes) -> dict[int, list[int]]:
    """Operands of each operator; two-byte operators are 1200 and more. Reals read as 0."""
    out, held, at = {}, [], 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12 and at < len(data):
                b = 1200 + data[at]
                at += 1
            out[b], held = held, []
        elif b == 28:
            held.append(int.from_bytes(data[at : at + 2], "big", signed=True))
            at += 2
        elif b == 29:
            held.append(int.from_bytes(data[at : at + 4], "big", signed=True))
            at += 4
        elif b == 30:
            while at < len(data) and data[at] & 15 != 15 and data[at] >> 4 != 15:
                at += 1
            at += 1
            held.append(0)
        elif 32 <= b <= 246:
            held.append(b - 139)
        elif 247 <= b <= 254 and at < len(data):
            held.append((b - 247) * 256 + data[at] + 108 if b <= 250 else -(b - 251) * 256 - data[at] - 108)
            at += 1
    return out


def cff(data: bytes) -> Font:
    at = _get(data, 2, "B")[0]
    _, at = _index(data, at)
    tops, at = _index(data, at)
    strings, _ = _index(data, at)
    if not tops:
        raise PdfError("SyntaxError", "CFF without a top dictionary")
    top = cff_dict(tops[0])
    where = top.get(17, [0])[-1] if top.get(17) else 0
    n = len(_index(data, where)[0]) if where > 0 else 0
    charset = top.get(15, [0])[-1] if top.get(15) else 0
    sids = [0]
    if charset <= 2:
        sids += range(1, min(n, 229) if n else 229)
    else:
        kind, at = _get(data, charset, "B")[0], charset + 1
        try:
            while len(sids) < n:
                if kind == 0:
                    sids.append(_get(data, at, ">H")[0])
                    at += 2
                else:
                    first, left = _get(data, at, ">HB" if kind == 1 else ">HH")
                    at += 3 if kind == 1 else 4
                    sids += range(first, first + min(left + 1, n - len(sids)))
        except PdfError:
            pass  # what was read so far counts
    font = Font()
    for gid, sid in enumerate(sids):
        name = CFF_STRINGS[sid] if sid < 391 else strings[sid - 391].decode("latin-1") if sid - 391 < len(strings) else None
        if gid and (c := glyph_to_char(name)) is not None:
            font.glyphs[gid] = c
    return font
