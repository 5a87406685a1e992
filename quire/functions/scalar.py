"""Scalar functions that need a byte loop, as Arrow-batched UDFs; `register` makes them SQL functions.

A value that can't be decoded is null; `*_error` functions give the kind of the fault instead.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import crypto, encodings
from ..kernel.base import PdfError
from ..kernel.ccitt import CcittParams, decode_ccitt
from ..kernel.cmap import CMap
from ..kernel.filters import ascii85, decode, unpredict
from ..kernel.glyphs import glyph_to_char
from ..kernel.jbig2 import decode_jbig2
from ..kernel.lexer import unescape
from ..kernel.writer import dump


def _try(f, *args):
    if any(a is None for a in args):
        return None
    try:
        return f(*(bytes(a) if isinstance(a, (bytearray, memoryview)) else a for a in args))
    except (PdfError, ValueError, OverflowError):
        return None


def _kind(f, *args):
    try:
        f(*args)
    except PdfError as e:
        return e.kind
    return None


def _spec(filters: str) -> list[tuple[str, dict]]:
    """'A85 Fl' or JSON [["CCITTFaxDecode", {"K": -1}], ...]."""
    if filters.lstrip().startswith("["):
        return [(n, p) for n, p in json.loads(filters)]
    return [(n, {}) for n in filters.split()]


@F.pandas_udf(T.BinaryType())
def pdf_decode(raw: pd.Series, filters: pd.Series) -> pd.Series:
    return pd.Series([_try(lambda r, f: decode(r, _spec(f)), r, f) for r, f in zip(raw, filters, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pdf_decode_error(raw: pd.Series, filters: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or f is None else _kind(decode, bytes(r), _spec(f)) for r, f in zip(raw, filters, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_ascii85_decode(raw: pd.Series) -> pd.Series:
    return pd.Series([_try(ascii85, r) for r in raw], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_ccitt_decode(raw: pd.Series, k: pd.Series, columns: pd.Series, rows: pd.Series, black_is_1: pd.Series) -> pd.Series:
    def one(r, k, c, n, b):
        return decode_ccitt(r, CcittParams(k=int(k), columns=int(c), rows=int(n), black_is_1=bool(b)))

    return pd.Series([_try(one, *a) for a in zip(raw, k, columns, rows, black_is_1, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_jbig2_decode(raw: pd.Series) -> pd.Series:
    return pd.Series([_try(decode_jbig2, r) for r in raw], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_unpredict(raw: pd.Series, predictor: pd.Series, columns: pd.Series, colors: pd.Series) -> pd.Series:
    return pd.Series([_try(lambda r, p, c, n: unpredict(r, int(p), int(c), int(n)), *a) for a in zip(raw, predictor, columns, colors, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_rc4(raw: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([_try(crypto.rc4, r, k) for r, k in zip(raw, key, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pdf_decode_text(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([_try(lambda r, e: encodings.decode_text(r, encodings.encoding_name(e)), r, e) for r, e in zip(raw, encoding, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_unescape(raw: pd.Series) -> pd.Series:
    return pd.Series([_try(unescape, r) for r in raw], dtype=object)


@F.pandas_udf(T.StringType())
def pdf_cmap_decode(cmap: pd.Series, raw: pd.Series) -> pd.Series:
    parsed: dict = {}

    def one(c, r):
        if c not in parsed:
            parsed[c] = CMap.parse(c)
        return parsed[c].decode(r)

    return pd.Series([_try(one, c, r) for c, r in zip(cmap, raw, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pdf_glyph_to_unicode(name: pd.Series) -> pd.Series:
    return pd.Series([glyph_to_char(n) for n in name], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_serialize(value: pd.Series) -> pd.Series:
    """A real as a PDF number."""
    return pd.Series([None if v is None or v != v else dump(float(v)) for v in value], dtype=object)


@F.pandas_udf(T.BinaryType())
def pdf_string(raw: pd.Series) -> pd.Series:
    """Bytes as a PDF literal string."""
    return pd.Series([None if r is None else dump(bytes(r)) for r in raw], dtype=object)


ALL = (
    pdf_decode, pdf_decode_error, pdf_ascii85_decode, pdf_ccitt_decode, pdf_jbig2_decode, pdf_unpredict, pdf_rc4, pdf_decode_text, pdf_unescape,
    pdf_cmap_decode, pdf_glyph_to_unicode, pdf_serialize, pdf_string,
)


def register(spark: SparkSession) -> None:
    for f in ALL:
        spark.udf.register(f.__name__, f)
