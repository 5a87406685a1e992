"""Table functions for SQL: `SELECT f.doc_id, t.* FROM files f, LATERAL pdf_pages(f.content) t` after `register(spark)`.

Each parses the document it is given; a password may follow the content. The relations in `operators.tables` do the same in
one narrow pass for many documents and are the faster way; these are for documents that a query has at hand. A document
that can't be read gives no rows, or a row with the kind of the fault where there is an `error` column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..kernel.base import PdfError, kind_of
from ..kernel.content import operations
from ..kernel.document import Document
from ..kernel.jbig2 import segments
from ..kernel.lexer import tokens
from ..operators.tables import KINDS, UNEXPECTED, fault, tagged, token_row

_FAULTS = (PdfError, *UNEXPECTED)


def _open(content, password) -> Document:
    if isinstance(password, str):
        password = password.encode()
    return Document.load(bytes(content or b""), bytes(password or b""))


def _tokens(content, _password):
    for seq, t in enumerate(tokens(bytes(content or b""))):
        yield (seq, *token_row(*t))


def _xref(content, password):
    for n, (kind, a, b) in sorted(_open(content, password).xref.entries.items()):
        yield n, KINDS[kind], a, b


def _objects(content, password):
    d = _open(content, password)
    for n, entry in sorted(d.xref.entries.items()):
        if entry[0] != "f":
            try:
                v = d.object(n)
                yield n, kind_of(v), json.dumps(tagged(v)), None
            except _FAULTS as e:
                yield n, None, None, fault(e)[0]


def _pages(content, password):
    for i, n in enumerate(_open(content, password).page_ids()):
        yield i + 1, n


def _operations(content, password):
    d = _open(content, password)
    for i, n in enumerate(d.page_ids()):
        for seq, (op, args) in enumerate(operations(d.page_content(n))):
            yield i + 1, seq, op, json.dumps([tagged(a) for a in args])


def _text(content, password, exact=False):
    d = _open(content, password)
    for i, n in enumerate(d.page_ids()):
        try:
            yield i + 1, d.page_text(n, exact=exact), None
        except _FAULTS as e:
            yield i + 1, None, fault(e)[0]


def _exact_text(content, password):
    yield from _text(content, password, True)


def _spans(content, password):
    d = _open(content, password)
    for i, n in enumerate(d.page_ids()):
        for seq, (text, box, font, size, bold, italic, _) in enumerate(d.page_spans(n)):
            yield i + 1, seq, text, *box, font, size, bold, italic


def _segments(content, _password):
    for number, kind, page, payload in segments(bytes(content or b"")):
        yield number, kind, page, payload


#: Name, columns and rows of each function.
ALL: dict[str, tuple[str, Callable[..., Iterator[tuple]]]] = {
    "pdf_tokens": ("seq int, pos bigint, kind string, i bigint, r double, s string, bytes binary", _tokens),
    "pdf_xref": ("obj_id bigint, kind string, a bigint, b bigint", _xref),
    "pdf_objects": ("obj_id bigint, kind string, value string, error string", _objects),
    "pdf_pages": ("page_no int, page_obj_id bigint", _pages),
    "pdf_operations": ("page_no int, seq int, operator string, operands string", _operations),
    "pdf_text": ("page_no int, text string, error string", _text),
    "pdf_exact_text": ("page_no int, text string, error string", _exact_text),
    "pdf_spans": (
        "page_no int, seq int, text string, min_x float, min_y float, max_x float, max_y float, font_name string, font_size float, is_bold boolean, is_italic boolean",
        _spans,
    ),
    "jbig2_segments": ("number bigint, type int, page bigint, payload binary", _segments),
}


def _handler(rows: Callable[..., Iterator[tuple]]) -> type:
    class Handler:
        def eval(self, content, password=None):
            try:
                yield from rows(content, password)
            except _FAULTS:
                return

    return Handler


def register(spark: SparkSession) -> None:
    for name, (schema, rows) in ALL.items():
        spark.udtf.register(name, udtf(_handler(rows), returnType=schema))
