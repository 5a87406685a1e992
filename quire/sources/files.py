"""Files of a corpus as files(doc_id, path, length, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*.[pP][dD][fF]"
MAX_BYTES = 2147483647  # what a Spark row can hold; longer files are out of scope


def read_pdfs(spark: SparkSession, *paths: str) -> DataFrame:
    """All PDFs under the paths. The paths are united as they are: a file that two of them reach comes twice."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN)
    df = reduce(DataFrame.unionByName, map(reader.load, paths))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "modificationTime", "length", "content")


def from_bytes(spark: SparkSession, rows: list[tuple[int, bytes]]) -> DataFrame:
    """In-memory documents."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id bigint, content binary")


def read_at(content, offset, size):
    """A range of a binary column, null where it does not lie inside."""
    inside = (offset >= 0) & (size >= 0) & (offset + size <= F.length(content))
    return F.when(inside, F.substring(content, (offset + 1).cast("int"), size.cast("int")))
