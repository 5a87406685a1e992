"""Values of the PDF object model and the error that kernels raise."""

from __future__ import annotations

from typing import NamedTuple

WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
MAX_BYTES = 256 * 1024 * 1024
MAX_ITEMS = 2_000_000
MAX_DEPTH = 256
CONTENT_DEPTH = 64
MAX_PAGES = 10_000_000
MAX_CHAIN = 32

#: Kinds an error can have; BrokenXref and MissingTrailer are names kept for callers and never raised.
ERROR_KINDS = (
    "UnexpectedEof SyntaxError InvalidNumber InvalidHexString UnterminatedString RecursionLimitExceeded BrokenXref CyclicReference"
    " TruncatedFile UnsupportedFilter MissingTrailer RecoveryFailed Io Unsupported Decryption"
).split()


class PdfError(Exception):
    def __init__(self, kind: str, message: str = "", offset: int | None = None):
        super().__init__(message or kind)
        self.kind, self.message, self.offset = kind, message or kind, offset

    def row(self) -> tuple:
        return self.kind, self.offset, self.message


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    id: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    data: bytes


class Keyword(bytes):
    __slots__ = ()


def as_dict(value) -> dict | None:
    """The dictionary of a dictionary or a stream."""
    return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else None


def kind_of(value) -> str:
    if value is None:
        return "null"
    for t, k in ((bool, "bool"), (int, "int"), (float, "real"), (Name, "name"), (bytes, "string"), (Ref, "ref"), (Stream, "stream"), (list, "array"), (dict, "dict")):
        if isinstance(value, t):
            return k
    raise TypeError(type(value).__name__)


def read_at(data: bytes, offset: int, size: int) -> bytes:
    """A range of data, which must lie inside it."""
    if offset < 0 or size < 0 or offset + size > len(data):
        raise PdfError("TruncatedFile", f"expected offset {offset + size}, file length is {len(data)}", offset)
    return data[offset : offset + size]
