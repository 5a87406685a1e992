"""CCITT fax decoding, after ITU-T T.4 and T.6."""

from __future__ import annotations

from dataclasses import dataclass

from .base import MAX_BYTES, PdfError

_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100
0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100
00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011
01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
_WHITE_LONG = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000
0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100
000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110
000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100
000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001
000000101011 000000101100 000001011010 000001100110 000001100111""".split()
_BLACK_LONG = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101
0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111
0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
_BOTH_LONG = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111
000000011100 000000011101 000000011110 000000011111""".split()


def _codes(short: list[str], long: list[str]) -> dict[tuple[int, int], int]:
    runs = dict(enumerate(short)) | {64 * (i + 1): c for i, c in enumerate(long)} | {1792 + 64 * i: c for i, c in enumerate(_BOTH_LONG)}
    return {(len(c), int(c, 2)): n for n, c in runs.items()}


WHITE_RUNS, BLACK_RUNS = _codes(_WHITE, _WHITE_LONG), _codes(_BLACK, _BLACK_LONG)
_PASS, _HORIZONTAL, _END, _EXTENSION = "P", "H", "E", "X"
MODES = {(len(c), int(c, 2)): m for c, m in (("1", 0), ("011", 1), ("000011", 2), ("0000011", 3), ("010", -1), ("000010", -2), ("0000010", -3), ("0001", _PASS), ("001", _HORIZONTAL), ("0000001", _EXTENSION), ("000000000001", _END))}


@dataclass
class CcittParams:
    k: int = 0
    end_of_line: bool = False
    encoded_byte_align: bool = False
    columns: int = 1728
    rows: int = 0
    end_of_block: bool = True
    black_is_1: bool = False

    @staticmethod
    def of(d: dict) -> CcittParams:
        def number(key, default):
            return d[key] if type(d.get(key)) is int else default

        def flag(key, default):
            return d[key] if isinstance(d.get(key), bool) else default

        return CcittParams(number("K", 0), flag("EndOfLine", False), flag("EncodedByteAlign", False), number("Columns", 1728), number("Rows", 0), flag("EndOfBlock", True), flag("BlackIs1", False))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        """n bits, zeros past the end."""
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[first:last].ljust(last - first, b"\0"), "big")
        return (v >> ((last << 3) - self.at - n)) & ((1 << n) - 1)

    def code(self, table: dict, longest: int):
        word = self.peek(longest)
        for n in range(1, longest + 1):
            v = table.get((n, word >> (longest - n)))
            if v is not None:
                if self.at + n > self.end:
                    break
                self.at += n
                return v
        raise PdfError("SyntaxError", "bad CCITT code", self.at >> 3)

    def run(self, black: bool) -> int:
        total = 0
        while True:
            n = self.code(BLACK_RUNS if black else WHITE_RUNS, 13)
            total += n
            if n < 64:
                return total

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    def skip_eol(self) -> bool:
        """An end-of-line code at the cursor, with fill bits before it."""
        back = self.at
        while self.at < self.end and self.peek(12) == 0:
            self.at += 1
        if self.peek(12) == 1 and self.at + 12 <= self.end:
            self.at += 12
            return True
        self.at = back
        return False


def _line_1d(bits: _Bits, columns: int) -> list[int]:
    """Columns where the colour changes, beginning with white."""
    out, at, black = [], 0, False
    while at < columns:
        at = min(columns, at + bits.run(black))
        out.append(at)
        black = not black
    return out


def _line_2d(bits: _Bits, columns: int, above: list[int]) -> list[int] | None:
    """The changes of a line against those of the line above; None at the end of the block."""
    out: list[int] = []
    a0, black = -1, False
    while a0 < columns:
        mode = bits.code(MODES, 12)
        if mode == _END:
            return None
        if mode == _EXTENSION:
            raise PdfError("Unsupported", "CCITT extension code")
        # b1: first change above, right of a0, to the opposite of the current colour
        i = 0
        while i < len(above) and (above[i] <= a0 or (i % 2 == 1) != black):
            i += 1
        b1 = above[i] if i < len(above) else columns
        b2 = above[i + 1] if i + 1 < len(above) else columns
        if mode == _PASS:
            a0 = b2
        elif mode == _HORIZONTAL:
            start = max(a0, 0)
            first = min(columns, start + bits.run(black))
            second = min(columns, first + bits.run(not black))
            out += [first, second]
            a0 = second
        else:
            a1 = min(columns, max(0, b1 + mode))
            out.append(a1)
            a0, black = a1, not black
        if a0 >= columns:
            break
    return out


def _pack(changes: list[int], columns: int, black_is_1: bool) -> bytes:
    row = 0
    for i in range(0, len(changes), 2):  # black from an even change to the next
        a, z = changes[i], changes[i + 1] if i + 1 < len(changes) else columns
        if z > a:
            row |= ((1 << (z - a)) - 1) << (columns - z)
    if not black_is_1:
        row ^= (1 << columns) - 1
    size = (columns + 7) // 8
    return (row << (size * 8 - columns)).to_bytes(size, "big")


def decode_ccitt(raw: bytes, p: CcittParams) -> bytes:
    columns = p.columns
    if columns <= 0 or columns > 1 << 24:
        raise PdfError("Unsupported", "CCITT columns out of range")
    size = (columns + 7) // 8
    if max(p.rows, 0) * size > MAX_BYTES:
        raise PdfError("Unsupported", "decompressed CCITT stream exceeds 256 MB safety limit")
    bits, out, above, rows = _Bits(raw), bytearray(), [], 0
    while (p.rows <= 0 or rows < p.rows) and bits.at < bits.end:
        if p.encoded_byte_align:
            bits.align()
        if p.k >= 0:
            eol = bits.skip_eol()
            if bits.at >= bits.end or eol and bits.peek(12) == 1:  # nothing more, or a return to control
                break
            flat = p.k == 0 or bits.peek(1) == 1
            if p.k > 0:
                bits.at += 1
        else:
            flat = False
        if bits.at >= bits.end or p.rows <= 0 and bits.peek(min(24, bits.end - bits.at)) == 0:
            break  # only fill is left
        line = _line_1d(bits, columns) if flat else _line_2d(bits, columns, above)
        if line is None:
            break
        out += _pack(line, columns, p.black_is_1)
        if len(out) > MAX_BYTES:
            raise PdfError("Unsupported", "decompressed CCITT stream exceeds 256 MB safety limit")
        above, rows = line, rows + 1
    return bytes(out)
