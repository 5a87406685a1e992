"""PDF bytes from objects."""

from __future__ import annotations

import re
import zlib

from .base import Name, PdfError, Ref, Stream, as_dict

_SPECIAL = re.compile(rb"[()\\]")


def real(x: float) -> bytes:
    """Five decimals at most, without trailing zeros."""
    return f"{x:.5f}".rstrip("0").rstrip(".").encode()


def dump(value) -> bytes:
    if value is None:
        return b"null"
    if value is True or value is False:
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return real(value)
    if isinstance(value, Name):
        return b"/" + value.encode()
    if isinstance(value, bytes):
        return b"(" + _SPECIAL.sub(rb"\\\g<0>", value) + b")"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, list):
        return b"[" + b" ".join(map(dump, value)) + b"]"
    if isinstance(value, dict):
        return b"<<\n" + b"".join(b"/" + k.encode() + b" " + dump(v) + b"\n" for k, v in sorted(value.items())) + b">>"
    if isinstance(value, Stream):
        d = {k: v for k, v in value.dict.items() if k != "Length"}
        rest = b"".join(b"/" + k.encode() + b" " + dump(v) + b"\n" for k, v in sorted(d.items()))
        return b"<<\n/Length %d\n" % len(value.data) + rest + b">>\nstream\n" + value.data + b"\nendstream"
    raise TypeError(type(value).__name__)


class Serializer:
    """Bytes written so far, and where they are."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.written = 0

    def write(self, raw: bytes) -> None:
        self.parts.append(raw)
        self.written += len(raw)

    def header(self, version: str = "1.7") -> None:
        self.write(b"%PDF-" + version.encode() + b"\n%" + "âãÏÓ".encode() + b"\n")

    def indirect(self, n: int, gen: int, value) -> int:
        at = self.written
        self.write(b"%d %d obj\n" % (n, gen) + dump(value) + b"\nendobj\n")
        return at

    def value(self) -> bytes:
        return b"".join(self.parts)


def _subsections(ids: list[int]):
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[i - 1] + 1:
            yield ids[start:i]
            start = i


def write_classic(objects: dict[int, object], trailer: dict, version: str = "1.7") -> bytes:
    """All objects and one classic table with as many subsections as the ids need."""
    out = Serializer()
    out.header(version)
    at = {n: out.indirect(n, 0, objects[n]) for n in sorted(objects)}
    start = out.written
    lines = [b"xref\n"]
    for run in _subsections([0, *sorted(objects)]):
        lines.append(b"%d %d\n" % (run[0], len(run)))
        lines += [b"0000000000 65535 f \n" if n == 0 else b"%010d 00000 n \n" % at[n] for n in run]
    out.write(b"".join(lines))
    keep = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID", "Encrypt")}
    out.write(b"trailer\n" + dump(keep | {"Size": max(objects, default=0) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
    return out.value()


def write_packed(objects: dict[int, object], trailer: dict, predictor: int = 1) -> bytes:
    """Streams first, all else in one compressed object stream, and a binary cross-reference; classic if nothing can be packed."""
    loose = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
    if not loose:
        return write_classic(objects, trailer, "1.5")
    out = Serializer()
    out.header("1.5")
    rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    for n in sorted(set(objects) - set(loose)):
        rows[n] = (1, out.indirect(n, 0, objects[n]), 0)
    container, table = max(objects) + 1, max(objects) + 2
    heads, body, at = [], [], 0
    for i, n in enumerate(sorted(loose)):
        raw = dump(loose[n])
        heads.append(b"%d %d" % (n, at))
        body.append(raw)
        at += len(raw) + 1
        rows[n] = (2, container, i)
    head = b" ".join(heads) + b"\n"
    d = {"Type": Name("ObjStm"), "N": len(loose), "First": len(head), "Filter": Name("FlateDecode")}
    rows[container] = (1, out.indirect(container, 0, Stream(d, zlib.compress(head + b"\n".join(body), 9))), 0)
    start = out.written
    rows[table] = (1, start, 0)
    ids = sorted(rows)
    lines = [bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(4, "big") for k, a, b in (rows[n] for n in ids)]
    parms = {}
    if predictor >= 10:
        above, coded = bytes(9), []
        for line in lines:
            coded.append(b"\x02" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True)))
            above = line
        lines, parms = coded, {"DecodeParms": {"Predictor": predictor, "Columns": 9}}
    d = {"Type": Name("XRef"), "Size": table + 1, "W": [1, 4, 4], "Index": [x for run in _subsections(ids) for x in (run[0], len(run))], "Filter": Name("FlateDecode")} | parms
    d |= {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}
    out.indirect(table, 0, Stream(d, zlib.compress(b"".join(lines), 9)))
    out.write(b"startxref\n%d\n%%%%EOF\n" % start)
    return out.value()


def pack(doc) -> tuple[bytes, int]:
    """A compact copy of a document, and how many of its objects could not be read."""
    objects, skipped = {}, 0
    enc = doc.xref.trailer.get("Encrypt")
    for n, entry in doc.xref.entries.items():
        if entry[0] == "f" or isinstance(enc, Ref) and enc.id == n:
            continue
        try:
            value = doc.object(n)
        except PdfError:
            skipped += 1
            continue
        if (as_dict(value) or {}).get("Type") in ("ObjStm", "XRef") and isinstance(value, Stream):
            continue
        objects[n] = value
    return write_packed(objects, doc.xref.trailer), skipped
