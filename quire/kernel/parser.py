"""Objects from tokens."""

from __future__ import annotations

from .base import MAX_DEPTH, MAX_ITEMS, Keyword, Name, PdfError, Ref, Stream
from .lexer import ARRAY_END, ARRAY_START, DICT_END, DICT_START, END, Lexer


def parse_object(lex: Lexer, max_depth: int = MAX_DEPTH, depth: int = 0):
    """The object at the cursor."""
    at = lex.pos
    return _from(lex, lex.next(), max_depth, depth, at)


def _from(lex: Lexer, t, max_depth: int, depth: int, at: int):
    if depth > max_depth:
        raise PdfError("RecursionLimitExceeded", f"depth limit {max_depth}", at)
    if t is END:
        raise PdfError("UnexpectedEof", "object expected", at)
    if not isinstance(t, Keyword):
        if type(t) is int and 0 < t < 2**32:
            return _reference(lex, t)
        return t
    if t is ARRAY_START:
        return _array(lex, max_depth, depth)
    if t is DICT_START:
        d = _dictionary(lex, max_depth, depth)
        back = lex.pos
        try:
            if lex.next() == b"stream":
                size = d.get("Length")
                return Stream(d, lex.stream_payload(size if type(size) is int and size >= 0 else None))
        except PdfError:
            if lex.data[back : back + 32].lstrip().startswith(b"stream"):
                raise
        lex.pos = back
        return d
    raise PdfError("SyntaxError", f"unexpected {t.decode('latin-1')[:40]}", at)


def _reference(lex: Lexer, first: int):
    back = lex.pos
    try:
        gen = lex.next()
        if type(gen) is int and 0 <= gen < 65536 and lex.next() == b"R":
            return Ref(first, gen)
    except PdfError:
        pass
    lex.pos = back
    return first


def _array(lex: Lexer, max_depth: int, depth: int) -> list:
    out: list = []
    while True:
        at = lex.pos
        t = lex.next()
        if t is ARRAY_END:
            return out
        if len(out) >= MAX_ITEMS:
            raise PdfError("Unsupported", "array has too many elements", at)
        out.append(_from(lex, t, max_depth, depth + 1, at))


def _dictionary(lex: Lexer, max_depth: int, depth: int) -> dict:
    out: dict = {}
    while True:
        at = lex.pos
        t = lex.next()
        if t is DICT_END:
            return dict(sorted(out.items()))
        if t is END:
            raise PdfError("UnexpectedEof", "dictionary not closed", at)
        if not isinstance(t, Name):
            raise PdfError("SyntaxError", "dictionary key is not a name", at)
        if len(out) >= MAX_ITEMS:
            raise PdfError("Unsupported", "dictionary has too many keys", at)
        out[str(t)] = parse_object(lex, max_depth, depth + 1)


def indirect_at(data: bytes, offset: int) -> tuple[int, int, object]:
    """(id, generation, object) written at offset; its numbers are not held against anything."""
    lex = Lexer(data, offset)
    n, g, word = lex.next(), lex.next(), lex.next()
    if word != b"obj":
        raise PdfError("SyntaxError", "obj expected", offset)
    return n, g, parse_object(lex)
