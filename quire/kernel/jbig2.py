"""JBIG2 segments and the raster of a page whose regions are stored plainly; coded regions are passed on as they are."""

from __future__ import annotations

from .base import MAX_BYTES, PdfError

_MAGIC = b"\x97JB2\r\n\x1a\n"
PAGE_INFO, REGIONS, REGION_HEADER = 48, (38, 39, 42, 43), 17


def segments(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(number, type, page, payload) of each segment; payloads that run over are clipped."""
    at, out = 0, []
    if data.startswith(_MAGIC):
        at = 9 if len(data) > 8 and data[8] & 2 else 13  # the number of pages follows if it is known
    while at + 11 <= len(data):
        number, flags = int.from_bytes(data[at : at + 4], "big"), data[at + 4]
        at += 5
        refs = data[at] >> 5
        if refs == 7:
            refs = int.from_bytes(data[at : at + 4], "big") & 0x1FFFFFFF
            at += 4 + (refs + 8) // 8
        else:
            at += 1
        at += refs * (1 if number <= 256 else 2 if number <= 65536 else 4)
        wide = 4 if flags & 0x40 else 1
        if at + wide + 4 > len(data):
            break
        page = int.from_bytes(data[at : at + wide], "big")
        size = int.from_bytes(data[at + wide : at + wide + 4], "big")
        at += wide + 4
        out.append((number, flags & 0x3F, page, data[at : at + size]))
        at += size
    return out


def decode_jbig2(data: bytes, shared: bytes | None = None) -> bytes:
    """The page's rows, padded or cut to its size; without a size or payload the input itself. shared adds no pixels."""
    width = height = 0
    body = bytearray()
    for _, kind, _, payload in segments(data):
        if kind == PAGE_INFO and len(payload) >= 8:
            width, height = (int.from_bytes(payload[i : i + 4], "big") for i in (0, 4))
        elif kind in REGIONS and len(payload) >= REGION_HEADER:
            w, h = (int.from_bytes(payload[i : i + 4], "big") for i in (0, 4))
            width, height = width or w, height or h
            body += payload[REGION_HEADER:]
    want = (width + 7) // 8 * height
    if want > MAX_BYTES or len(body) > MAX_BYTES:
        raise PdfError("Unsupported", "decompressed JBIG2 stream exceeds 256 MB safety limit")
    if want:
        return bytes(body[:want]).ljust(want, b"\0")
    return bytes(body) or data
