"""Writing PDFs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernel.base import PdfError
from ..kernel.document import Document
from ..kernel.writer import pack as pack_document
from ..kernel.writer import write_classic
from .batches import ERROR, map_documents, with_password
from .tables import UNEXPECTED, fault

_INPUTS = ["doc_id", "content", "password"]


def _rewrite(files: DataFrame, how) -> DataFrame:
    def rows(doc_id, content, password):
        try:
            d = Document.load(content or b"", password or b"")
            out, skipped = how(d)
            yield doc_id, out, len(content), len(out), skipped, None
        except (PdfError, *UNEXPECTED) as e:
            yield doc_id, None, len(content or b""), None, None, fault(e)

    schema = f"doc_id bigint, content binary, original_bytes bigint, packed_bytes bigint, skipped bigint, error {ERROR}"
    return map_documents(with_password(files), rows, schema, _INPUTS, weight=lambda r: len(r[1] or b""))


def packed(files: DataFrame) -> DataFrame:
    """Compact copies: object streams and a binary cross-reference. One narrow pass; nothing is shuffled."""
    return _rewrite(files, pack_document)


def rewritten(files: DataFrame) -> DataFrame:
    """Copies with one classic table; objects from object streams are written out too."""

    def how(d: Document):
        objs, skipped = {}, 0
        for n, e in d.xref.entries.items():
            if e[0] != "f":
                try:
                    objs[n] = d.object(n)
                except PdfError:
                    skipped += 1
        return write_classic(objs, {k: v for k, v in d.xref.trailer.items() if k != "Encrypt"}), skipped

    return _rewrite(files, how)


def report(done: DataFrame) -> DataFrame:
    """Sizes before and after, and the share saved or grown."""
    return done.selectExpr(
        "doc_id", "original_bytes", "packed_bytes",
        "greatest(0, 100.0D * (original_bytes - packed_bytes) / original_bytes) as saved_percent",
        "greatest(0, 100.0D * (packed_bytes - original_bytes) / original_bytes) as grown_percent",
    )
