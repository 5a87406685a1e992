"""Cross-reference tables and streams, and rebuilding them."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .base import Name, PdfError, Ref, Stream
from .filters import flate, unpredict
from .lexer import Lexer
from .parser import parse_object

_START = re.compile(rb"startxref")
_OBJ = re.compile(rb"(?:(?<=[\t\n\x0c\r ])|\A)obj(?=[\x00\t\n\x0c\r <\[(/%]|\Z)")
_HEAD = re.compile(rb"(?:\A|[^0-9])([0-9]{1,10})[\x00\t\n\x0c\r ]+([0-9]{1,5})[\x00\t\n\x0c\r ]*\Z")
_LOOK_BACK = 64
_MARK = re.compile(rb"endobj|stream")
#: An entry as nearly all files write it; others go through the lexer.
_ENTRY = re.compile(rb"[\t\n\x0c\r ]*([0-9]{1,10})[ ]+([0-9]{1,5})[ ]+([nf])(?=[\t\n\x0c\r ])")


@dataclass
class Xref:
    """Entries by object: ('n', offset, generation), ('c', container, index) or ('f', next, generation); rows in revision order."""

    entries: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    revisions: list[tuple] = field(default_factory=list)  # (revision from the newest 0, id, entry)
    recovered: bool = False


def start_offset(data: bytes) -> int:
    """What the last startxref of the last 2048 bytes says."""
    base = max(0, len(data) - 2048)
    found = [m.end() for m in _START.finditer(data, base)]
    if not found:
        raise PdfError("SyntaxError", "no startxref", base)
    n = Lexer(data, found[-1]).next()
    if type(n) is not int or not 0 <= n < len(data):
        raise PdfError("SyntaxError", "startxref out of range", found[-1])
    return n


def _classic(data: bytes, lex: Lexer, rows: list, revision: int) -> dict:
    limit = max(1, len(data) // 20)
    while True:
        t = lex.next()
        if t == b"trailer":
            d = parse_object(lex)
            if not isinstance(d, dict):
                raise PdfError("SyntaxError", "trailer is not a dictionary", lex.pos)
            return d
        count = lex.next()
        if type(t) is not int or type(count) is not int or t < 0 or count < 0:
            raise PdfError("SyntaxError", "bad xref subsection", lex.pos)
        if count > limit:
            raise PdfError("SyntaxError", "xref subsection longer than the file", lex.pos)
        for i in range(count):
            if m := _ENTRY.match(data, lex.pos):
                lex.pos = m.end()
                rows.append((revision, t + i, (m[3].decode(), int(m[1]), int(m[2]))))
                continue
            offset, gen, kind = lex.next(), lex.next(), lex.next()
            if type(offset) is not int or type(gen) is not int or kind not in (b"n", b"f"):
                raise PdfError("SyntaxError", "bad xref entry", lex.pos)
            rows.append((revision, t + i, ("n" if kind == b"n" else "f", offset, gen)))


def _stream(data: bytes, stream: Stream, rows: list, revision: int) -> dict:
    d = stream.dict
    if d.get("Type") != "XRef":
        raise PdfError("SyntaxError", "not an xref stream")
    f = d.get("Filter")
    body = flate(stream.data) if f == "FlateDecode" or f == [Name("FlateDecode")] else stream.data
    parms = d.get("DecodeParms")
    if isinstance(parms, list) and parms:
        parms = parms[0]
    if isinstance(parms, dict):
        whole = lambda k, n: parms[k] if type(parms.get(k)) is int and parms[k] > 0 else n
        body = unpredict(body, whole("Predictor", 1), whole("Columns", 1), whole("Colors", 1), whole("BitsPerComponent", 8))
    w = d.get("W")
    if not isinstance(w, list) or len(w) < 3:
        raise PdfError("SyntaxError", "bad /W")
    w = [x if type(x) is int and 0 <= x <= 8 else 0 for x in w[:3]]
    size = d.get("Size") if type(d.get("Size")) is int else 0
    index = d.get("Index") if isinstance(d.get("Index"), list) else [0, size]
    at, width = 0, sum(w)
    if not width:
        raise PdfError("SyntaxError", "bad /W")
    for first, count in zip(index[0::2], index[1::2], strict=False):
        if type(first) is not int or type(count) is not int:
            continue
        for n in range(first, first + min(count, (len(body) - at) // width)):
            a, b, c = (int.from_bytes(body[at + s : at + s + k], "big") for s, k in ((0, w[0]), (w[0], w[1]), (w[0] + w[1], w[2])))
            at += width
            kind = a if w[0] else 1
            if kind <= 2:
                rows.append((revision, n, (("f", "n", "c")[kind], b, c)))
    return d


def parse(data: bytes, merge: str = "newest") -> Xref:
    """All sections from startxref along /Prev. merge 'overwrite' lets older classic entries win."""
    out, at, seen, rows = Xref(), start_offset(data), set(), []
    revision = 0
    while at not in seen:
        seen.add(at)
        lex = Lexer(data, at)
        back = at
        new: list = []
        try:
            t = lex.next()
            if t == b"xref":
                d, over = _classic(data, lex, new, revision), merge == "overwrite"
            elif type(t) is int:
                lex.seek(back)
                lex.next(), lex.next()
                if lex.next() != b"obj":
                    break
                value = parse_object(lex)
                if not isinstance(value, Stream):
                    break
                d, over = _stream(data, value, new, revision), False
            else:
                break
        except PdfError:
            if revision == 0:
                raise
            break
        for _, n, entry in new:
            if over or n not in out.entries:
                out.entries[n] = entry
        rows += new
        for k, v in d.items():
            out.trailer.setdefault(k, v)
        revision += 1
        prev = d.get("Prev")
        if type(prev) is not int or not 0 < prev < len(data):
            break
        at = prev
    out.revisions = rows
    return out


def _payload(data: bytes, at: int) -> tuple[int, int] | None:
    """Where the payload lies of the stream object whose value is at `at`, if its length holds: `endstream` follows it."""
    lex = Lexer(data, at)
    try:
        value = parse_object(lex)
    except PdfError:
        return None
    if not isinstance(value, Stream) or type(size := value.dict.get("Length")) is not int or len(value.data) != size:
        return None
    end = data.rfind(b"endstream", at, lex.pos)
    start = data.rfind(b"stream", at, end - size)
    return (start, end) if start >= 0 else None


def repair(data: bytes) -> Xref:
    """Entries from every `id gen obj` in the file, the last of an id; the trailer from the last trailer dictionary that
    parses, else from a catalogue marker and the object that stands before it. What reads as one of these in the payload of a stream
    whose length holds is none."""
    out, starts, hidden = Xref(recovered=True), [], [(-1, -1)]
    mark = _MARK.search(data)
    for m in _OBJ.finditer(data):
        if m.start() < hidden[-1][1]:
            continue
        base = max(0, m.start() - _LOOK_BACK)
        head = _HEAD.search(data[base : m.start()])
        if head and 0 < int(head[1]) < 2**32 and int(head[2]) < 65536:
            at = base + head.start(1)
            out.entries[int(head[1])] = ("n", at, int(head[2]))
            starts.append((at, int(head[1])))
            if mark and mark.start() < m.end():
                mark = _MARK.search(data, m.end())
            if mark and mark[0] == b"stream" and (part := _payload(data, m.end())):
                hidden.append(part)
    if not out.entries:
        raise PdfError("RecoveryFailed", "no objects found")

    def shown(pattern: bytes):
        for m in re.finditer(pattern, data):
            start, end = hidden[bisect_right(hidden, (m.start(), len(data))) - 1]
            if not start <= m.start() < end:
                yield m

    found = False
    for m in shown(rb"trailer"):
        try:
            d = parse_object(Lexer(data, m.end()))
        except PdfError:
            continue
        if isinstance(d, dict):
            out.trailer, found = d, True
    if not found or "Root" not in out.trailer:
        # xref streams hold the trailer of files without a table
        for at, _ in starts:
            lex = Lexer(data, at)
            try:
                lex.next(), lex.next(), lex.next()
                back = lex.pos
                d = lex.data[back : back + 4096]
                if b"/XRef" in d and isinstance(s := parse_object(lex), Stream) and s.dict.get("Type") == "XRef" and "Root" in s.dict:
                    out.trailer, found = dict(s.dict), True
            except PdfError:
                continue
    if not found or "Root" not in out.trailer:
        for m in shown(rb"/Catalog(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)"):
            before = [(at, n) for at, n in starts if at < m.start()]
            if before:
                n = max(before)[1]
                out.trailer = {"Root": Ref(n, out.entries[n][2]), "Size": len(out.entries) + 1}
                break
    out.revisions = [(0, n, e) for n, e in out.entries.items()]
    return out


def parse_or_repair(data: bytes, merge: str = "newest") -> Xref:
    try:
        out = parse(data, merge)
        if out.entries:
            return out
    except PdfError:
        pass
    return repair(data)


