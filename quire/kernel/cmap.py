"""ToUnicode character maps."""

from __future__ import annotations

import re
import struct

from .encodings import TABLES, encoding_name

RANGE_LIMIT = 65536
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|<([^>]*)>?|\(((?:[^()\\]|\\.)*)\)?|\[|\]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+", re.S)
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")


def _hex(raw: bytes) -> bytes:
    digits = _NOT_HEX.sub(b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def target(raw: bytes) -> str:
    """The text of a destination."""
    if len(raw) == 1:
        return chr(raw[0])
    if len(raw) % 2 == 0:
        try:
            return raw.decode("utf-16-be")
        except UnicodeDecodeError:
            pass
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _plus(raw: bytes, n: int) -> bytes:
    size = len(raw)
    return ((int.from_bytes(raw, "big") + n) % (1 << (8 * size))).to_bytes(size, "big") if size else raw


class CMap:
    def __init__(self, codes: dict[int, str] | None = None, spaces: list[tuple[int, int, int]] | None = None, wide: bool | None = None):
        self.codes = codes or {}
        self.spaces = spaces or []
        self.wide = any(c > 0xFF for c in self.codes) if wide is None else wide

    def insert(self, code: int, text: str) -> None:
        self.codes[code] = text
        self.wide |= code > 0xFF

    def lookup(self, code: int) -> str | None:
        return self.codes.get(code)

    def lookup_char(self, code: int) -> str | None:
        t = self.codes.get(code)
        return t if t is not None and len(t) == 1 else None

    def __len__(self) -> int:
        return len(self.codes)

    @staticmethod
    def parse(data: bytes) -> CMap:
        """Never fails; what can't be read is passed over."""
        out, mode, held = CMap(), b"", []

        def flush(final: bool = False):
            nonlocal held
            if mode == b"codespacerange":
                while len(held) >= 2:
                    lo, hi, *held = held
                    if isinstance(lo, bytes) and isinstance(hi, bytes) and lo:
                        out.spaces.append((len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big")))
                        out.wide |= len(lo) >= 2
            elif mode == b"bfchar":
                while len(held) >= 2:
                    code, to, *held = held
                    if isinstance(code, bytes) and isinstance(to, bytes):
                        out.insert(int.from_bytes(code, "big"), target(to))
                        out.wide |= len(code) >= 2
            elif mode == b"bfrange":
                while len(held) >= 3:
                    lo, hi, to, *held = held
                    if not isinstance(lo, bytes) or not isinstance(hi, bytes):
                        continue
                    a, z = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                    out.wide |= len(lo) >= 2
                    if z < a or z - a > RANGE_LIMIT:
                        continue
                    if isinstance(to, list):
                        for i, t in enumerate(to[: z - a + 1]):
                            out.insert(a + i, target(t))
                    elif isinstance(to, bytes):
                        for i in range(z - a + 1):
                            out.insert(a + i, target(_plus(to, i)))

        array: list | None = None
        for m in _TOKEN.finditer(data):
            t = m[0]
            if t[:1] == b"%":
                continue
            value = _hex(m[1]) if m[1] is not None else m[2] if m[2] is not None else None
            if t == b"[":
                array = []
            elif t == b"]":
                if array is not None and mode:
                    held.append(array)
                    flush()
                array = None
            elif t.startswith(b"begin") and t[5:] in (b"bfchar", b"bfrange", b"codespacerange"):
                mode, held = t[5:], []
            elif t.startswith(b"end") and t[3:] == mode and mode:
                flush()
                mode, held = b"", []
            elif mode and value is not None:
                if array is not None:
                    array.append(value)
                else:
                    held.append(value)
                    if len(held) == (3 if mode == b"bfrange" else 2):
                        flush()
        return out

    def _one(self, code: int, table: str) -> str:
        t = self.codes.get(code)
        if t is not None:
            return t
        if code <= 0xFF:
            return table[code]
        return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "�"

    def decode(self, raw: bytes, encoding: str = "WinAnsiEncoding") -> str:
        table, out, i, n = TABLES[encoding_name(encoding)], [], 0, len(raw)
        if self.spaces:
            if len(self.spaces) == 1 and (size := self.spaces[0][0]) and n % size == 0:
                _, lo, hi = self.spaces[0]
                if size == 2 and (lo, hi) == (0, 0xFFFF):
                    texts = list(map(self.codes.get, struct.unpack(f">{n // 2}H", raw)))
                    if None not in texts:
                        return "".join(texts)
                codes = [int.from_bytes(raw[i : i + size], "big") for i in range(0, n, size)]
                if all(lo <= c <= hi for c in codes):
                    return "".join([self._one(c, table) for c in codes])
            while i < n:
                for size, lo, hi in self.spaces:
                    if i + size <= n and lo <= (code := int.from_bytes(raw[i : i + size], "big")) <= hi:
                        out.append(self._one(code, table))
                        i += size
                        break
                else:
                    out.append(self._one(raw[i], table))
                    i += 1
            return "".join(out)
        if self.wide and n >= 2 and n % 2 == 0:
            codes = [raw[i] << 8 | raw[i + 1] for i in range(0, n, 2)]
            if any(c in self.codes for c in codes):
                return "".join(self._one(c, table) for c in codes)
        while i < n:
            if i + 1 < n and (t := self.codes.get(raw[i] << 8 | raw[i + 1])) is not None and self.wide:
                out.append(t)
                i += 2
            else:
                out.append(self._one(raw[i], table))
                i += 1
        return "".join(out)
