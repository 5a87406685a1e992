"""Single-precision geometry and positioned text spans."""

from __future__ import annotations

import math
from ctypes import c_float

import numpy as np

from .encodings import decode_text

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
STACK = 256
EMPTY_SIZE = 12.0


def f32(x: float) -> float:
    return c_float(x).value


def multiply(m: tuple, n: tuple) -> tuple:
    """m then n, as row-vector affine matrices (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    g = f32
    return (
        g(g(a * p) + g(b * r)),
        g(g(a * q) + g(b * s)),
        g(g(c * p) + g(d * r)),
        g(g(c * q) + g(d * s)),
        g(g(g(e * p) + g(f * r)) + t),
        g(g(g(e * q) + g(f * s)) + u),
    )


def translation(x: float, y: float) -> tuple:
    return 1.0, 0.0, 0.0, 1.0, f32(x), f32(y)


def scaling(x: float, y: float) -> tuple:
    return f32(x), 0.0, 0.0, f32(y), 0.0, 0.0


def rotation(angle: float) -> tuple:
    c, s = f32(math.cos(angle)), f32(math.sin(angle))
    return c, s, -s, c, 0.0, 0.0


def point(m: tuple, x: float, y: float) -> tuple[float, float]:
    g = f32
    return g(g(g(x * m[0]) + g(y * m[2])) + m[4]), g(g(g(x * m[1]) + g(y * m[3])) + m[5])


def rect(x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    """Corners in order; a NaN gives way to the other side."""
    lo = lambda a, b: b if a != a else a if b != b else min(a, b)
    hi = lambda a, b: b if a != a else a if b != b else max(a, b)
    return lo(x0, x1), lo(y0, y1), hi(x0, x1), hi(y0, y1)


def bounds(m: tuple, r: tuple) -> tuple[float, float, float, float]:
    """Of the four transformed corners of r."""
    if m[1] == 0.0 and m[2] == 0.0:
        return rect(*point(m, r[0], r[1]), *point(m, r[2], r[3]))
    out = None
    for x, y in ((r[0], r[1]), (r[2], r[1]), (r[0], r[3]), (r[2], r[3])):
        p = point(m, x, y)
        out = (*p, *p) if out is None else rect(*rect(out[0], out[1], *p)[:2], *rect(out[2], out[3], *p)[2:])
    return out  # type: ignore[return-value]


def inverse(m: tuple) -> tuple | None:
    a, b, c, d, e, f = m
    g = f32
    det = g(g(a * d) - g(b * c))
    if abs(det) <= 1e-12:
        return None
    k = g(1 / det)
    return (
        g(d * k), g(-b * k), g(-c * k), g(a * k),
        g(g(g(c * f) - g(d * e)) * k), g(g(g(b * e) - g(a * f)) * k),
    )


_NARROW, _WIDE = set(" .,:;!'|iljtfrI1"), set("mwMW@%—")


def default_width(ch: str) -> float:
    return 278.0 if ch in _NARROW else 750.0 if ch in _WIDE else 500.0


def style_of(name: str) -> tuple[bool, bool]:
    low = name.lower()
    return any(s in low for s in ("bold", "black", "heavy", "demi")), any(s in low for s in ("italic", "oblique", "slanted"))


def _number(v) -> float | None:
    return f32(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


#: Operators of one number, and what it sets.
_SETS = {"Tc": "char_space", "Tw": "word_space", "Tz": "scale", "TL": "leading", "Ts": "rise"}


class Steps(dict):
    """Advance of each character under one font, size and spacing; found when first asked for."""

    def __init__(self, info, size: float, char_space: float, word_space: float, scale: float):
        self.info, self.size, self.char_space, self.word_space, self.scale = info, size, char_space, word_space, scale

    def __missing__(self, ch: str) -> float:
        g = f32
        w = self.info.widths.get(ord(ch)) if self.info else None
        if w is None:
            w = self.info.missing if self.info and self.info.missing is not None else default_width(ch)
        step = g(g(g(w / 1000.0) * self.size) + self.char_space)
        if ch == " ":
            step = g(step + self.word_space)
        self[ch] = step = g(step * self.scale)
        return step

    def along(self, s: str, start: float) -> float:
        """start and the advances of s, added one after another in single precision."""
        steps = np.fromiter(map(self.__getitem__, s), np.float32, len(s))
        with np.errstate(all="ignore"):
            steps[0] += np.float32(start)
            return float(np.add.accumulate(steps)[-1])


class Tracker:
    """Folds operations into spans: (text, bbox, font name, size, bold, italic, matrix)."""

    def __init__(self, fonts: dict | None = None, threshold: float = -100.0):
        self.fonts, self.threshold = fonts or {}, threshold
        self.ctm, self.stack = IDENTITY, []
        self.tm = self.line = IDENTITY
        self.font, self.size, self.encoding, self.cmap = "", 0.0, "WinAnsiEncoding", None
        self.char_space = self.word_space = self.leading = self.rise = 0.0
        self.scale = 100.0
        self.steps: dict[tuple, Steps] = {}

    def run(self, operations) -> list[tuple]:
        out: list[tuple] = []
        for op, args in operations:
            self._do(op, args, out)
        return out

    def _do(self, op: str, args: list, out: list) -> None:
        # an operand that is no number leaves what it would set; a matrix of six needs all of them, a move takes 0 for it
        n = [_number(a) for a in args[:6]] if op in ("cm", "Tm", "Td", "TD", "Tf", '"') or op in _SETS else []
        if op == "q":
            if len(self.stack) < STACK:
                self.stack.append((self.ctm, self.font, self.size, self.encoding, self.cmap, self.char_space, self.word_space, self.leading, self.rise, self.scale))
        elif op == "Q":
            if self.stack:
                self.ctm, self.font, self.size, self.encoding, self.cmap, self.char_space, self.word_space, self.leading, self.rise, self.scale = self.stack.pop()
        elif op == "cm":
            if len(n) == 6 and None not in n:
                self.ctm = multiply(tuple(n), self.ctm)
        elif op in ("BT", "ET"):
            self.tm = self.line = IDENTITY
        elif op == "Tf":
            if args:
                name = args[0].decode("utf-8", "ignore") if isinstance(args[0], bytes) else args[0] if isinstance(args[0], str) else ""
                self.font = str(name).lstrip("/")
                info = self.fonts.get(self.font)
                self.cmap = info.cmap if info else None
                if info and info.encoding:
                    self.encoding = info.encoding
            if len(n) > 1 and n[1] is not None:
                self.size = n[1]
        elif op in _SETS:
            if n and n[0] is not None:
                setattr(self, _SETS[op], n[0])
        elif op in ("Td", "TD"):
            x, y = (v or 0.0 for v in [*n, None, None][:2])
            if op == "TD":
                self.leading = -y
            self._move(x, y)
        elif op == "Tm":
            if len(n) == 6 and None not in n:
                self.tm = self.line = tuple(n)
        elif op == "T*":
            self._move(0.0, -self.leading)
        elif op == "Tj" and args and isinstance(args[0], bytes):
            self._show([args[0]], out)
        elif op == "TJ" and args and isinstance(args[0], list):
            self._show(args[0], out)
        elif op == "'" and args and isinstance(args[0], bytes):
            self._move(0.0, -self.leading)
            self._show([args[0]], out)
        elif op == '"':
            self.word_space, self.char_space = (old if v is None else v for v, old in zip([*n, None, None], (self.word_space, self.char_space)))
            self._move(0.0, -self.leading)
            if len(args) >= 3 and isinstance(args[2], bytes):
                self._show([args[2]], out)

    def _move(self, x: float, y: float) -> None:
        self.tm = self.line = multiply(translation(x, y), self.line)

    def _show(self, items: list, out: list) -> None:
        g = f32
        info = self.fonts.get(self.font)
        k = g(self.scale / 100.0)
        state = (self.font, self.size, self.char_space, self.word_space, k)
        if state not in self.steps:
            self.steps[state] = Steps(info, self.size, self.char_space, self.word_space, k)
        steps = self.steps[state]
        text, advance = "", 0.0
        for item in items:
            if isinstance(item, bytes):
                s = self.cmap.decode(item, self.encoding) if self.cmap else decode_text(item, self.encoding)
                if s:
                    advance = steps.along(s, advance)
                text += s.lstrip(" \t\n\r\x0b\x0c\x85\xa0") if text.endswith(" ") and s.startswith(" ") else s
            elif isinstance(item, (int, float)) and not isinstance(item, bool):
                v = f32(float(item))
                advance = g(advance + g(g(-g(v / 1000.0) * self.size) * k))
                if v <= self.threshold and text and not text.endswith(" "):
                    text += " "
        if not text:
            return
        device = multiply(self.tm, self.ctm)
        high = self.size if self.size > 0 else EMPTY_SIZE
        box = bounds(device, rect(0.0, self.rise, max(advance, 0.0), g(self.rise + high)))
        self.tm = multiply(translation(advance, 0.0), self.tm)
        bold, italic = style_of(self.font)
        out.append((text, box, self.font, self.size, bold or bool(info and info.bold), italic or bool(info and info.italic), device))
