"""Relations derived from files(doc_id, content[, password]).

Every relation is one narrow pass that parses a document where it lies; filters on doc_id belong before it, and page_text
and spans take the page numbers wanted, so that other pages are never parsed. A document that cannot be read gives a row
with an error, never a failed task.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel.base import Name, PdfError, Ref, Stream, as_dict, kind_of
from ..kernel.content import operations as parse_operations
from ..kernel.document import Document
from ..kernel.filters import filter_spec
from ..kernel.lexer import tokens as lex_tokens
from .batches import ERROR, map_columns, map_documents, with_password

_INPUTS = ["doc_id", "content", "password"]
KINDS = {"n": "in_use", "c": "compressed", "f": "free"}
UNEXPECTED = (RecursionError, MemoryError, ValueError, TypeError, IndexError, KeyError, OverflowError, AttributeError)


def fault(e: BaseException) -> tuple:
    return e.row() if isinstance(e, PdfError) else ("SyntaxError", None, f"{type(e).__name__}: {e}"[:200])


def _open(content, password, mode: str = "resilient", merge: str = "newest") -> Document:
    return Document.load(content or b"", password or b"", strict=mode == "strict", merge=merge)


def tagged(v):
    """A value as JSON that keeps names, strings and references apart."""
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        return v if v == v and abs(v) != float("inf") else {"k": "real", "s": str(v)}
    if isinstance(v, Name):
        return {"k": "name", "s": str(v)}
    if isinstance(v, bytes):
        return {"k": "str", "hex": v.hex().upper()}
    if isinstance(v, Ref):
        return {"k": "ref", "id": v.id, "gen": v.gen}
    if isinstance(v, Stream):
        return {"k": "stream", "dict": tagged(v.dict), "length": len(v.data)}
    if isinstance(v, list):
        return [tagged(x) for x in v]
    return {k: tagged(x) for k, x in v.items()}


def load(files: DataFrame, mode: str = "resilient", merge: str = "newest") -> DataFrame:
    """A row for each file: whether and how it opened. mode: resilient, or strict without the repair pass."""

    def rows(doc_id, content, password):
        try:
            d = _open(content, password, mode, merge)
            yield doc_id, mode, True, d.xref.recovered, d.encrypted, d.object_count(), d.xref_kind(), d.version(), None
        except (PdfError, *UNEXPECTED) as e:
            yield doc_id, mode, False, None, None, 0, None, None, fault(e)

    schema = f"doc_id bigint, mode string, ok boolean, recovered boolean, encrypted boolean, objects bigint, xref_kind string, version string, error {ERROR}"
    return map_documents(with_password(files), rows, schema, _INPUTS)


def security(files: DataFrame) -> DataFrame:
    """Parameters of each encrypted document's security handler, once its password has opened it; no row for a document that is not encrypted or stays shut."""

    def rows(doc_id, content, password):
        try:
            h = _open(content, password).security
        except (PdfError, *UNEXPECTED):
            return
        if h is not None:
            yield doc_id, h.version, h.revision, 8 * h.key_bytes, h.stream_cipher, h.string_cipher, h.permissions, h.encrypt_metadata, len(h.dek)

    schema = "doc_id bigint, version int, revision int, key_bits int, stream_cipher string, string_cipher string, permissions bigint, encrypt_metadata boolean, dek_bytes int"
    return map_documents(with_password(files), rows, schema, _INPUTS)


def xref(files: DataFrame, mode: str = "resilient", revisions: bool = False) -> DataFrame:
    """A row for each entry; with revisions, for each entry of each section, rev 0 the newest."""

    def rows(doc_id, content, password):
        try:
            d = _open(content, password, mode)
        except (PdfError, *UNEXPECTED):
            return
        found = d.xref.revisions if revisions else [(0, n, e) for n, e in d.xref.entries.items()]
        for rev, n, (kind, a, b) in found:
            yield (
                doc_id, n, KINDS[kind], a if kind == "n" else None, b if kind != "c" else None,
                a if kind == "c" else None, b if kind == "c" else None, a if kind == "f" else None, rev,
            )

    schema = "doc_id bigint, obj_id bigint, kind string, offset bigint, gen int, stm_id bigint, idx int, next_free bigint, rev int"
    return map_documents(with_password(files), rows, schema, _INPUTS)


def trailer(files: DataFrame) -> DataFrame:
    """Entries of the trailer; value is a VARIANT of the tagged form."""

    def rows(doc_id, content, password):
        try:
            d = _open(content, password)
        except (PdfError, *UNEXPECTED):
            return
        for k, v in d.xref.trailer.items():
            yield doc_id, k, json.dumps(tagged(v))

    out = map_documents(with_password(files), rows, "doc_id bigint, key string, value string", _INPUTS)
    return out.withColumn("value", F.parse_json("value"))


def _each_object(content, password):
    d = _open(content, password)
    for n, entry in sorted(d.xref.entries.items()):
        if entry[0] != "f":
            try:
                yield n, entry[2] if entry[0] == "n" else 0, d.object(n), None
            except (PdfError, *UNEXPECTED) as e:
                yield n, None, None, fault(e)


def objects(files: DataFrame) -> DataFrame:
    """Every object in use, without the payload of streams."""

    def rows(doc_id, content, password):
        try:
            for n, gen, v, error in _each_object(content, password):
                yield doc_id, n, gen, None if error else kind_of(v), None if error else json.dumps(tagged(v)), error
        except (PdfError, *UNEXPECTED) as e:
            yield doc_id, None, None, None, None, fault(e)

    out = map_documents(with_password(files), rows, f"doc_id bigint, obj_id bigint, gen int, kind string, value string, error {ERROR}", _INPUTS)
    return out.withColumn("value", F.parse_json("value"))


def _leaves(v, path: tuple):
    kind = kind_of(v)
    if kind in ("array", "dict", "stream"):
        items = enumerate(v) if kind == "array" else as_dict(v).items()
        yield path, kind, v
        for k, x in items:
            yield from _leaves(x, (*path, str(k)))
    else:
        yield path, kind, v


def object_kv(files: DataFrame) -> DataFrame:
    """Objects flattened to a row for each value in them, by path: the form that joins use."""

    def rows(doc_id, content, password):
        try:
            for n, _, v, error in _each_object(content, password):
                if error:
                    continue
                for path, kind, x in _leaves(v, ()):
                    yield (
                        doc_id, n, list(path), kind, x if kind == "bool" else None, x if kind == "int" else None, x if kind == "real" else None,
                        str(x) if kind == "name" else None, x if kind == "string" else None, x.id if kind == "ref" else None, x.gen if kind == "ref" else None,
                    )
        except (PdfError, *UNEXPECTED):
            return

    schema = "doc_id bigint, obj_id bigint, path array<string>, kind string, b boolean, i bigint, r double, s string, bytes binary, ref_id bigint, ref_gen int"
    return map_documents(with_password(files), rows, schema, _INPUTS)


def streams(files: DataFrame, decoded: bool = False) -> DataFrame:
    """Payloads of streams: raw and the names of their filters, decoded if asked for."""

    def rows(doc_id, content, password):
        try:
            d = _open(content, password)
        except (PdfError, *UNEXPECTED):
            return
        for n, entry in sorted(d.xref.entries.items()):
            if entry[0] != "n":
                continue
            try:
                v = d.object(n)
                if not isinstance(v, Stream):
                    continue
                names = [k for k, _ in filter_spec({k: d.resolve(x) for k, x in v.dict.items() if k in ("Filter", "DecodeParms")})]
                yield doc_id, n, v.data, names, d.stream_bytes(v) if decoded else None, None
            except (PdfError, *UNEXPECTED) as e:
                yield doc_id, n, None, None, None, fault(e)

    schema = f"doc_id bigint, obj_id bigint, raw binary, filters array<string>, decoded binary, error {ERROR}"
    return map_documents(with_password(files), rows, schema, _INPUTS, weight=lambda r: len(r[2] or b"") + len(r[4] or b""))


def pages(files: DataFrame) -> DataFrame:
    """Pages in order, page_no from 1."""

    def rows(doc_id, content, password):
        try:
            for i, n in enumerate(_open(content, password).page_ids()):
                yield doc_id, i + 1, n
        except (PdfError, *UNEXPECTED):
            return

    return map_documents(with_password(files), rows, "doc_id bigint, page_no int, page_obj_id bigint", _INPUTS)


def _each_page(doc_id, content, password, wanted, one):
    """one(document, page id) of every wanted page, with its number and its error."""
    try:
        d = _open(content, password)
        ids = d.page_ids()
    except (PdfError, *UNEXPECTED) as e:
        yield None, None, fault(e)
        return
    for i, n in enumerate(ids):
        if wanted is None or i + 1 in wanted:
            try:
                yield i + 1, one(d, n), None
            except (PdfError, *UNEXPECTED) as e:
                yield i + 1, None, fault(e)


def page_text(files: DataFrame, page_numbers: set[int] | None = None, kerning: float = -100.0, exact: bool = False) -> DataFrame:
    """Plain text of pages; exact keeps blanks at its ends, empty lines and blanks beside blanks, which are folded otherwise."""

    def rows(doc_id, content, password):
        for no, text, error in _each_page(doc_id, content, password, page_numbers, lambda d, n: d.page_text(n, kerning, exact)):
            yield doc_id, no, text, error

    return map_documents(with_password(files), rows, f"doc_id bigint, page_no int, text string, error {ERROR}", _INPUTS, weight=lambda r: len(r[2] or ""))


def document_text(files: DataFrame, kerning: float = -100.0, exact: bool = False) -> DataFrame:
    """Text of whole documents, exact as for page_text, pages apart by a newline; parsing and text in one pass. The first page that fails is the error."""

    def rows(doc_id, content, password):
        out, fault = [], None
        for _, text, error in _each_page(doc_id, content, password, None, lambda d, n: d.page_text(n, kerning, exact)):
            fault = fault or error
            out.append(text or "")
        yield doc_id, None if fault else "\n".join(out), len(out), fault

    return map_documents(with_password(files), rows, f"doc_id bigint, text string, pages int, error {ERROR}", _INPUTS, weight=lambda r: len(r[1] or ""))


_SPAN = (
    "seq int, text string, bbox struct<min_x:float,min_y:float,max_x:float,max_y:float>, font_name string, font_size float,"
    " is_bold boolean, is_italic boolean, transform struct<a:float,b:float,c:float,d:float,e:float,f:float>"
)


def spans(files: DataFrame, page_numbers: set[int] | None = None, kerning: float = -100.0) -> DataFrame:
    """Positioned spans of pages."""
    box, matrix = ("min_x", "min_y", "max_x", "max_y"), "abcdef"

    def rows(doc_id, content, password):
        for no, found, error in _each_page(doc_id, content, password, page_numbers, lambda d, n: d.page_spans(n, kerning)):
            if error:
                yield doc_id, no, *[None] * 8, error
            for seq, (text, b, font, size, bold, italic, m) in enumerate(found or ()):
                yield doc_id, no, seq, text, dict(zip(box, b, strict=True)), font, size, bold, italic, dict(zip(matrix, m, strict=True)), None

    return map_documents(with_password(files), rows, f"doc_id bigint, page_no int, {_SPAN}, error {ERROR}", _INPUTS)


def fonts(files: DataFrame, page_numbers: set[int] | None = None) -> DataFrame:
    """Fonts that pages can use: encoding, style, widths by code, and how many codes have a text of their own."""

    def rows(doc_id, content, password):
        for no, found, error in _each_page(doc_id, content, password, page_numbers, Document.fonts_of):
            if error:
                yield doc_id, no, *[None] * 8, error
            for name, f in sorted((found or {}).items()):
                yield doc_id, no, name, f.encoding, len(f.cmap) if f.cmap else 0, bool(f.cmap and f.cmap.wide), list(f.widths.items()), f.missing, f.bold, f.italic, None

    schema = f"doc_id bigint, page_no int, font_name string, encoding string, codes int, wide boolean, widths map<int,float>, missing_width float, is_bold boolean, is_italic boolean, error {ERROR}"
    return map_documents(with_password(files), rows, schema, _INPUTS)


def font_codes(files: DataFrame, page_numbers: set[int] | None = None) -> DataFrame:
    """The codes of pages' fonts and their texts, from ToUnicode maps or the embedded font file."""

    def rows(doc_id, content, password):
        for no, found, _ in _each_page(doc_id, content, password, page_numbers, Document.fonts_of):
            for name, f in sorted((found or {}).items()):
                for code, text in sorted(f.cmap.codes.items()) if f.cmap else ():
                    yield doc_id, no, name, code, text

    return map_documents(with_password(files), rows, "doc_id bigint, page_no int, font_name string, code bigint, text string", _INPUTS)


def operations(files: DataFrame, page_numbers: set[int] | None = None) -> DataFrame:
    """Content operations of pages in order; operands as tagged JSON."""

    def one(d, n):
        return [(op, json.dumps([tagged(a) for a in args])) for op, args in parse_operations(d.page_content(n))]

    def rows(doc_id, content, password):
        for no, found, error in _each_page(doc_id, content, password, page_numbers, one):
            if error:
                yield doc_id, no, None, None, None, error
            for seq, (op, args) in enumerate(found or ()):
                yield doc_id, no, seq, op, args, None

    return map_documents(with_password(files), rows, f"doc_id bigint, page_no int, seq int, operator string, operands string, error {ERROR}", _INPUTS)


def token_row(pos: int, kind: str, v) -> tuple:
    """(pos, kind, i, r, s, bytes) of a token."""
    return (
        pos, kind, v if kind == "int" else None, v if kind == "real" else None,
        str(v) if kind in ("name", "error") else (v.decode("latin-1") if kind == "keyword" else None), v if kind in ("string", "hex_string") else None,
    )


_TOKEN_COLUMNS = {"seq": "int", "pos": "bigint", "kind": "string", "i": "bigint", "r": "double", "s": "string", "bytes": "binary"}
_SHORT = {"seq", "kind", "i"}


def tokens(df: DataFrame, content_col: str = "content", content_syntax: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Tokens of a binary column, by the file's or by the content-stream grammar. columns: those beside doc_id that are wanted, else all."""
    names = list(_TOKEN_COLUMNS) if columns is None else columns

    def rows(raw):
        found = lex_tokens(raw or b"", content_syntax)
        if set(names) <= _SHORT:
            made = {"seq": range(len(found)), "kind": [t[1] for t in found], "i": [t[2] if t[1] == "int" else None for t in found]}
        else:
            made = dict(zip(_TOKEN_COLUMNS, (range(len(found)), *zip(*(token_row(*t) for t in found), strict=True)) if found else [()] * len(_TOKEN_COLUMNS), strict=True))
        return len(found), [made[c] for c in names]

    src = df.select("doc_id", F.col(content_col).alias("content"))
    return map_columns(src, rows, ", ".join(["doc_id bigint", *(f"{c} {_TOKEN_COLUMNS[c]}" for c in names)]), ["doc_id", "content"])
