"""Single-byte font encodings and text strings."""

from __future__ import annotations

from codecs import charmap_decode

LATIN = [chr(i) for i in range(256)]


def _with(changes: dict[int, str]) -> str:
    return "".join(changes.get(i, c) for i, c in enumerate(LATIN))


_WIN = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
WINANSI = _with(_WIN)
MACROMAN = _with({b: bytes([b]).decode("mac_roman") for b in range(128, 256)} | {0xDB: "¤"})
STANDARD = _with(
    dict(zip(range(0xA1, 0xB0), "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", strict=True))
    | {0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿"}
    | {0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—"}
    | {0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
)
PDFDOC = _with(_WIN | dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)))
TABLES = {"WinAnsiEncoding": WINANSI, "MacRomanEncoding": MACROMAN, "StandardEncoding": STANDARD, "PDFDocEncoding": PDFDOC}


def encoding_name(name: str | None) -> str:
    """A known encoding; anything else is WinAnsi."""
    n = (name or "").removeprefix("/")
    n = n if n in TABLES else n + "Encoding"
    return n if n in TABLES else "WinAnsiEncoding"


def utf16(raw: bytes, big: bool) -> str:
    """Lossy: an odd last byte is dropped, lone surrogates are replaced."""
    raw = raw[: len(raw) // 2 * 2]
    order = "big" if big else "little"
    units = [int.from_bytes(raw[i : i + 2], order) for i in range(0, len(raw), 2)]
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append(chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00))
            i += 2
            continue
        out.append("�" if 0xD800 <= u < 0xE000 else chr(u))
        i += 1
    return "".join(out)


def decode_text(raw: bytes, encoding: str = "WinAnsiEncoding") -> str:
    """By a byte order mark if there is one, else byte by byte."""
    if raw[:2] == b"\xfe\xff":
        return utf16(raw[2:], True)
    if raw[:2] == b"\xff\xfe":
        return utf16(raw[2:], False)
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return charmap_decode(raw, "strict", TABLES[encoding])[0] if encoding in TABLES else raw.decode("latin-1")
