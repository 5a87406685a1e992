"""Operations of content streams."""

from __future__ import annotations

import re

from .base import CONTENT_DEPTH, Keyword, Name, PdfError, Stream
from .lexer import ARRAY_END, ARRAY_START, DICT_END, DICT_START, END, Lexer

#: Every recognised operator by class.
CLASSES = {
    "text object": "BT ET",
    "text state": "Tf Tc Tw Tz TL Tr Ts",
    "text position": "Td TD Tm T*",
    "text show": "Tj TJ ' \"",
    "graphics state": "q Q cm w J j M d ri i gs",
    "path build": "m l c v y h re",
    "path paint": "S s f F f* B B* b b* n",
    "clip": "W W*",
    "colour": "CS cs SC SCN sc scn G g RG rg K k",
    "shading": "sh",
    "image": "Do BI ID EI",
    "marked content": "MP DP BMC BDC EMC",
    "compatibility": "BX EX",
    "type 3": "d0 d1",
}
OPERATOR_CLASS = {op: c for c, ops in CLASSES.items() for op in ops.split()}
_IMAGE_END = re.compile(rb"(?<=[\x00\t\n\x0c\r ])EI(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)")
# the commonest operations whole: a plain string shown, a move, a line
_FAST = re.compile(rb"[\x00\t\n\x0c\r ]*(?:\(([^()\\]*)\)[ \n]*(Tj|')(?=[\s]|\Z)|(-?\d+) (-?\d+) (Td|TD)(?=[\s]|\Z)|(T\*|BT|ET)(?=[\s]|\Z))")

# an array of plain strings and short whole numbers, shown
_SHOWN = re.compile(rb"[\x00\t\n\x0c\r ]*\[((?:\([^()\\]*+\)|-?[0-9]{1,9}(?=[ \n(\]])|[ \n]++)*+)\][ \n]*TJ(?=[\x00\t\n\x0c\r ]|\Z)")
_ITEM = re.compile(rb"\(([^()\\]*)\)|(-?[0-9]+)")


def inline_image(lex: Lexer) -> bytes:
    """The bytes between ID and a bounded EI; all the rest if there is none."""
    data = lex.data
    start = lex.pos + (1 if data[lex.pos : lex.pos + 1] and data[lex.pos] in b"\x00\t\n\x0c\r " else 0)
    m = _IMAGE_END.search(data, start)
    if not m:
        lex.pos = len(data)
        return data[start:]
    lex.pos = m.end()
    return data[start : max(start, m.start() - 1)]


def _object(lex: Lexer, t, depth: int, at: int):
    if depth > CONTENT_DEPTH:
        raise PdfError("RecursionLimitExceeded", f"depth limit {CONTENT_DEPTH}", at)
    if t is ARRAY_START:
        out: list = []
        while True:
            at, t = lex.pos, lex.next()
            if t is ARRAY_END or t is END:
                return out
            out.append(_object(lex, t, depth + 1, at))
    if t is DICT_START:
        d: dict = {}
        while True:
            at, t = lex.pos, lex.next()
            if t is DICT_END or t is END:
                return d
            if not isinstance(t, Name):
                raise PdfError("SyntaxError", "dictionary key is not a name", at)
            at, v = lex.pos, lex.next()
            if v is END:
                return d
            d[str(t)] = _object(lex, v, depth + 1, at)
    if isinstance(t, Keyword):
        raise PdfError("SyntaxError", f"unexpected {t.decode('latin-1')[:40]}", at)
    return t


def operations(data: bytes):
    """(operator, operands) one after the other; a fault ends them. Operands at the end without an operator are dropped."""
    lex, held = Lexer(data, content=True), []
    fast, shown, n = _FAST.match, _SHOWN.match, len(data)
    while True:
        if not held:
            while m := fast(data, lex.pos) or shown(data, lex.pos):
                lex.pos = m.end()
                k = m.lastindex
                if k == 1:
                    yield "TJ", [[int(number) if number else raw for raw, number in _ITEM.findall(m[1])]]
                elif k == 2:
                    yield m[2].decode(), [m[1]]
                elif k == 5:
                    yield m[5].decode(), [int(m[3]), int(m[4])]
                else:
                    yield m[6].decode(), []
            if lex.pos >= n:
                return
        at = lex.pos
        t = lex.next()
        if t is END:
            return
        if isinstance(t, Keyword) and t not in (ARRAY_START, DICT_START):
            if t in (ARRAY_END, DICT_END):
                raise PdfError("SyntaxError", "unbalanced bracket", at)
            op = t.decode("latin-1")
            if op == "ID":
                held.append(Stream({}, inline_image(lex)))
            yield op, held
            held = []
        else:
            held.append(_object(lex, t, 0, at))
