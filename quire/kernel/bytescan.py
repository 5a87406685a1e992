"""Byte classes, as compiled searches."""

from __future__ import annotations

import re

from .base import DELIMITERS, WHITE

_NOT_WHITE = re.compile(rb"[^\x00\t\n\x0c\r ]")
_EDGE = re.compile(rb"[\x00\t\n\x0c\r ()<>\[\]{}/%]")
IS_WHITE = bytes(b in WHITE for b in range(256))
IS_DELIMITER = bytes(b in DELIMITERS for b in range(256))


def find_non_whitespace(data: bytes, start: int = 0) -> int:
    m = _NOT_WHITE.search(data, start)
    return m.start() if m else len(data)


def find_delimiter_or_whitespace(data: bytes, start: int = 0) -> int:
    m = _EDGE.search(data, start)
    return m.start() if m else len(data)


def chunk_masks(chunk: bytes) -> tuple[int, int]:
    """Bit masks of white space and of delimiters in up to 32 bytes, lowest bit first."""
    white = delim = 0
    for i, b in enumerate(chunk):
        white |= IS_WHITE[b] << i
        delim |= IS_DELIMITER[b] << i
    return white, delim
