"""Stream filters."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .base import MAX_BYTES, Name, PdfError
from .ccitt import CcittParams, decode_ccitt
from .jbig2 import decode_jbig2

#: Of the five digits of an ASCII85 group.
_POWERS = np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)
_BLANK = re.compile(rb"[\x00\t\n\x0c\r ]+")
ABBREVIATIONS = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "CCF": "CCITTFaxDecode"}
KNOWN = ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "CCITTFaxDecode", "JBIG2Decode", "Identity")


def flate(raw: bytes, limit: int = MAX_BYTES) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(raw, limit + 1)
    except zlib.error as e:
        raise PdfError("Io", str(e)) from None
    if len(out) > limit:
        raise PdfError("Unsupported", "decompressed stream exceeds 256 MB safety limit")
    if not d.eof:
        raise PdfError("Io", "truncated flate stream")
    return out


def ascii_hex(raw: bytes) -> bytes:
    end = raw.find(b">")
    body = _BLANK.sub(b"", raw if end < 0 else raw[:end])
    if m := re.search(rb"[^0-9A-Fa-f]", body):
        raise PdfError("InvalidHexString", "bad hex digit", m.start())
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ascii85(raw: bytes) -> bytes:
    """Groups of five digits in base 85, `z` for four zeros between groups, `~>` at the end; overflow saturates."""
    end = raw.find(b"~>")
    body = _BLANK.sub(b"", raw if end < 0 else raw[:end])
    if m := re.search(rb"[^!-uz]", body):
        raise PdfError("SyntaxError", "bad ASCII85 character", m.start())
    if b"z" in body:
        at = np.flatnonzero(np.frombuffer(body, np.uint8) == 0x7A)
        if ((at - np.arange(len(at))) % 5).any():
            raise PdfError("SyntaxError", "z inside an ASCII85 group")
        if len(at) * 4 > MAX_BYTES:
            raise PdfError("Unsupported", "decompressed stream exceeds 256 MB safety limit")
        body = body.replace(b"z", b"!!!!!")
    if len(body) // 5 * 4 > MAX_BYTES:
        raise PdfError("Unsupported", "decompressed stream exceeds 256 MB safety limit")
    rest = -len(body) % 5
    digits = (np.frombuffer(body + b"u" * rest, np.uint8) - 33).reshape(-1, 5).astype(np.uint64)
    values = np.minimum(digits @ _POWERS, 0xFFFFFFFF).astype(">u4").tobytes()
    return values[: len(values) - rest]


def ascii85_encode(raw: bytes) -> bytes:
    """raw in groups of five digits, `z` for four zeros, without an end mark."""
    rest = -len(raw) % 4
    values = np.frombuffer(raw + bytes(rest), ">u4").astype(np.uint32)
    digits = np.empty((len(values), 5), np.uint8)
    zero = values == 0
    if rest:
        zero[-1] = False
    for i in range(4, -1, -1):
        values, digits[:, i] = values // 85, values % 85 + 33
    if zero.any():
        keep = np.ones_like(digits, bool)
        keep[zero, 1:], digits[zero, 0] = False, 0x7A
        digits = digits[keep]
    out = digits.tobytes()
    return out[: len(out) - rest]


def decode(raw: bytes, filters: list[tuple[str, dict]]) -> bytes:
    """raw through all filters, left to right. Each is (name, parameters)."""
    data = raw
    if len(data) > MAX_BYTES:
        raise PdfError("Unsupported", "stream exceeds 256 MB safety limit")
    for name, parms in filters:
        name = ABBREVIATIONS.get(name, name)
        if name == "FlateDecode":
            data = flate(data)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "CCITTFaxDecode":
            data = decode_ccitt(data, CcittParams.of(parms))
        elif name == "JBIG2Decode":
            data = decode_jbig2(data, parms.get("globals"))
        elif name != "Identity":
            raise PdfError("UnsupportedFilter", name)
        if len(data) > MAX_BYTES:
            raise PdfError("Unsupported", "decompressed stream exceeds 256 MB safety limit")
    return data


def filter_spec(d: dict) -> list[tuple[str, dict]]:
    """Filters of a stream dictionary, with their parameters."""
    f, p = d.get("Filter"), d.get("DecodeParms", d.get("DP"))
    names = [f] if isinstance(f, Name) else [x for x in f if isinstance(x, Name)] if isinstance(f, list) else []
    parms = p if isinstance(p, list) else [p]
    out = []
    for i, n in enumerate(names):
        full = ABBREVIATIONS.get(n, str(n))
        if full not in KNOWN:
            raise PdfError("UnsupportedFilter", str(n))
        at = parms[i] if i < len(parms) else None
        out.append((full, at if isinstance(at, dict) else {}))
    return out


def unpredict(data: bytes, predictor: int, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undo a PNG (10 to 15) or TIFF (2) predictor; other values change nothing."""
    if predictor < 2:
        return data
    bpp = max(1, colors * bits // 8)
    width = (columns * colors * bits + 7) // 8
    if width <= 0:
        return data
    out = bytearray()
    if predictor == 2:
        for at in range(0, len(data), width):
            row = bytearray(data[at : at + width])
            for i in range(bpp, len(row)):
                row[i] = (row[i] + row[i - bpp]) & 0xFF
            out += row
        return bytes(out)
    above = bytes(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if kind == 1:
            for i in range(bpp, len(row)):
                row[i] = (row[i] + row[i - bpp]) & 0xFF
        elif kind == 2:
            for i in range(len(row)):
                row[i] = (row[i] + above[i]) & 0xFF
        elif kind == 3:
            for i in range(len(row)):
                row[i] = (row[i] + ((row[i - bpp] if i >= bpp else 0) + above[i]) // 2) & 0xFF
        elif kind == 4:
            for i in range(len(row)):
                left, up, corner = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
                guess = left + up - corner
                row[i] = (row[i] + min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]) & 0xFF
        above = bytes(row) + bytes(width - len(row))
        out += row
    return bytes(out)
