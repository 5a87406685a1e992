"""File-arrival ingestion: a convenience over the same relations, since a PDF is read whole and never as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..sources.files import PATTERN


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """files(doc_id, path, length, content) of PDFs as they arrive under path."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def text_to_parquet(spark: SparkSession, path: str, out: str, checkpoint: str, **trigger):
    """Page texts of arriving files, appended to Parquet exactly once."""
    query = tables.page_text(arriving(spark, path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
