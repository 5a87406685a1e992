"""files(doc_id, content, password) made from rows of text, inside the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import synth
from ..operators.batches import map_documents

_SCHEMA = "doc_id bigint, content binary, password binary"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", password: bytes | None = None, keep_nulls: bool = False, **layout) -> DataFrame:
    """A PDF for each row; layout as for synth.build. A null text is an empty page, or with keep_nulls no document."""

    def rows(doc_id, text):
        # one seed for a corpus: its key derivation is then done once a worker
        yield doc_id, None if keep_nulls and text is None else synth.build(text or "", password=password or b"", seed=b"corpus", **layout), password

    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_documents(src, rows, _SCHEMA, ["doc_id", "text"], weight=lambda r: len(r[1] or b""))


def contents(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """A one-page PDF whose content stream is a binary column."""

    def rows(doc_id, raw):
        font, extra, _ = synth.font_dict("winansi")
        yield doc_id, synth.write_classic(synth.objects([raw or b""], font, extra), {"Root": synth.Ref(1, 0)}), None

    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(content_col).alias("raw"))
    return map_documents(src, rows, _SCHEMA, ["doc_id", "raw"], weight=lambda r: len(r[1]))


def revised(df: DataFrame, first: str, second: str, id_col: str = "doc_id") -> DataFrame:
    """Documents that showed one column and were changed to show another."""

    def rows(doc_id, a, b):
        yield doc_id, synth.with_revision(a or "", b or ""), None

    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
    return map_documents(src, rows, _SCHEMA, ["doc_id", "a", "b"])
