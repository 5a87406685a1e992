"""Tokens of PDF syntax: one scanner for files and one for content streams."""

from __future__ import annotations

import re

from .base import Keyword, Name, PdfError

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)+")
_BLANK = re.compile(rb"[\x00\t\n\x0c\r ]+")
#: Blanks and comments, then a whole number that ends here, a name, a bracket, or a run of regular characters.
_TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*"
    rb"(?:([+-]?[0-9]{1,18})(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)|/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(<<|>>|\[|\])|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+))?"
)
_PLAIN = re.compile(rb"[^()\\]*")
#: The rest of a string without brackets but escaped ones.
_FLAT = re.compile(rb"[^()\\]*+(?:\\.[^()\\]*+)*+\)", re.S)
#: What is more than an escaped bracket or backslash; a backslash before may be escaped itself.
_MORE = re.compile(rb"\\(?:[^()\\]|\Z)")
_PAIR = re.compile(rb"\\(.)", re.S)
_INT = re.compile(rb"[+-]?[0-9]+\Z")
_REAL = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)\Z", re.I)
_NUMBER = re.compile(rb"[+-]?(?:([0-9]+)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?")
_HEX_BAD = re.compile(rb"[^0-9A-Fa-f\x00\t\n\x0c\r ]")
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f", ord("("): b"(", ord(")"): b")", ord("\\"): b"\\"}
_OCTAL = re.compile(rb"[0-7]{1,3}")

#: Kinds of tokens; comments are skipped and never come out.
ARRAY_START, ARRAY_END, DICT_START, DICT_END = Keyword(b"["), Keyword(b"]"), Keyword(b"<<"), Keyword(b">>")
END = object()
_MARKS = {bytes(k): k for k in (ARRAY_START, ARRAY_END, DICT_START, DICT_END)}
_MARK_KINDS = {b"[": "array_start", b"]": "array_end", b"<<": "dict_start", b">>": "dict_end"}


def unescape(raw: bytes) -> bytes:
    """Literal-string escapes in raw bytes: named, octal modulo 256, line continuations; others keep the character."""
    if b"\\" not in raw:
        return raw
    if not _MORE.search(raw):
        return _PAIR.sub(rb"\1", raw)
    out, at = bytearray(), 0
    while (i := raw.find(b"\\", at)) >= 0:
        out += raw[at:i]
        if i + 1 >= len(raw):
            at = i + 1
            break
        c = raw[i + 1]
        if c in _ESCAPES:
            out += _ESCAPES[c]
            at = i + 2
        elif m := _OCTAL.match(raw, i + 1):
            out.append(int(m[0], 8) & 0xFF)
            at = m.end()
        elif c == 0x0D:
            at = i + 3 if raw[i + 2 : i + 3] == b"\n" else i + 2
        elif c == 0x0A:
            at = i + 2
        else:
            out.append(c)
            at = i + 2
    return bytes(out + raw[at:])


class Lexer:
    """A cursor over data. content: numbers and operators as in content streams."""

    def __init__(self, data: bytes, pos: int = 0, content: bool = False):
        self.data, self.pos, self.content = data, min(max(pos, 0), len(data)), content

    def seek(self, pos: int) -> None:
        self.pos = min(max(pos, 0), len(self.data))

    def at_end(self) -> bool:
        return self.pos >= len(self.data)

    def skip_blanks(self) -> None:
        if m := _BLANK.match(self.data, self.pos):
            self.pos = m.end()

    def skip(self) -> None:
        if m := _SKIP.match(self.data, self.pos):
            self.pos = m.end()

    def next(self):
        """The next token, END at the end: None, bool, int, float, Name, bytes of a string, or a Keyword."""
        data = self.data
        m = _TOKEN.match(data, self.pos)
        self.pos = m.end()
        k = m.lastindex
        if k == 1:
            return int(m[1])
        if k == 2:
            try:
                return Name(m[2].decode())
            except UnicodeDecodeError:
                raise PdfError("SyntaxError", "name is not UTF-8", m.start(2) - 1) from None
        if k == 3:
            return _MARKS[m[3]]
        if k == 4:
            if self.content and (n := _NUMBER.match(data, m.start(4))):
                self.pos = n.end()
                if n[1] is not None and n[2] is None and n[3] is None and -(2**63) <= int(n[0]) < 2**63:
                    return int(n[0])
                return float(n[0])
            return self._regular(m[4])
        at = self.pos
        if at >= len(data):
            return END
        if data[at] == 0x28:
            return self._literal(at)
        if data[at] == 0x3C:
            return self._hex(at)
        self.pos = at + 1
        raise PdfError("SyntaxError", "lone >" if data[at] == 0x3E else "unexpected delimiter", at)

    def _regular(self, t: bytes):
        if t == b"true":
            return True
        if t == b"false":
            return False
        if t == b"null":
            return None
        if not self.content:
            if _INT.match(t):
                n = int(t)
                return n if -(2**63) <= n < 2**63 else float(t)
            if _REAL.match(t):
                return float(t)
        return Keyword(t)

    def _literal(self, start: int) -> bytes:
        if m := _FLAT.match(self.data, start + 1):
            self.pos = m.end()
            return unescape(self.data[start + 1 : m.end() - 1])
        data, at, depth, escaped = self.data, start + 1, 1, False
        while True:
            at = _PLAIN.match(data, at).end()
            if at >= len(data):
                self.pos = at
                raise PdfError("UnterminatedString", "unterminated string", start)
            c = data[at]
            if c == 0x5C:
                escaped = True
                at += 2
                continue
            at += 1
            depth += 1 if c == 0x28 else -1
            if not depth:
                break
        self.pos = at
        raw = data[start + 1 : at - 1]
        return unescape(raw) if escaped else raw

    def _hex(self, start: int) -> bytes:
        end = self.data.find(b">", start)
        if end < 0:
            self.pos = len(self.data)
            raise PdfError("UnexpectedEof", "unterminated hex string", start)
        raw = self.data[start + 1 : end]
        if m := _HEX_BAD.search(raw):
            self.pos = start + 2 + m.start()
            raise PdfError("InvalidHexString", "bad hex digit", start + 1 + m.start())
        self.pos = end + 1
        digits = _BLANK.sub(b"", raw)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def stream_payload(self, size: int | None) -> bytes:
        """What follows the keyword `stream`: size bytes if `endstream` follows them, else up to the next `endstream`."""
        data = self.data
        if data[self.pos : self.pos + 1] == b"\r":
            self.pos += 1
        if data[self.pos : self.pos + 1] == b"\n":
            self.pos += 1
        start = self.pos
        if size is not None and start + size <= len(data):
            self.pos = start + size
            if self.next() == b"endstream":
                return data[start : start + size]
        end = data.find(b"endstream", start)
        if end < 0:
            raise PdfError("UnexpectedEof", "no endstream", start)
        self.pos = end + 9
        if data[end - 1 : end] == b"\n" and end > start:
            end -= 2 if data[end - 2 : end] == b"\r\n" and end - 2 >= start else 1
        return data[start:end]


def tokens(data: bytes, content: bool = False) -> list[tuple[int, str, object]]:
    """(position, kind, value) of all tokens; the first fault ends the list as an `error` row."""
    lex, out = Lexer(data, content=content), []
    match, size = _TOKEN.match, len(data)
    while True:
        m = match(data, lex.pos)
        k = m.lastindex
        # most kinds are told by the match alone
        if k == 1:
            out.append((m.start(1), "int", int(m[1])))
            lex.pos = m.end()
            continue
        if k == 3:
            out.append((m.start(3), _MARK_KINDS[m[3]], _MARKS[m[3]]))
            lex.pos = m.end()
            continue
        at = m.end() if k is None else m.start(k) - (k == 2)
        if at >= size:
            return out
        try:
            if k == 4 and not content:
                t = lex._regular(m[4])
                lex.pos = m.end()
            elif k is None and data[at] == 0x28:
                t = lex._literal(at)
            else:
                lex.pos = at
                t = lex.next()
        except PdfError as e:
            out.append((at, "error", e.kind))
            return out
        if isinstance(t, Keyword):
            kind = "keyword"
        elif isinstance(t, Name):
            kind = "name"
        elif isinstance(t, bytes):
            kind = "hex_string" if data[at] == 0x3C else "string"
        else:
            kind = "null" if t is None else "bool" if isinstance(t, bool) else "int" if isinstance(t, int) else "real"
        out.append((at, kind, t))
