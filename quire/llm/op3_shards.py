"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

Law `key`: doc_id and the number of shards alone decide, and with one more shard a row stays or moves to the new shard.
The hash is the published 64-bit linear congruential jump; the key is doc_id itself.

slot numbers the rows of a shard from 0 without gaps, by doc_id (then crc, size). No shard is gathered to number it: rows
are range-partitioned once as narrow records, equal ones split by a row number, each partition counts its rows of each shard as it goes, and the counts of
the partitions before it are added by a small join.

Nulls and odd cases: a null text has size 8 and the crc of no bytes, 0; a row with a null doc_id has the key 0; repeated
rows get a slot each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

OVERHEAD = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, shards) of each 64-bit key."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    b, j = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    while (todo := np.flatnonzero(j < shards)).size:
        b[todo] = j[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        j[todo] = ((b[todo] + 1).astype(np.float64) * (2147483648.0 / ((key[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return b.astype(np.int32)


def _number(shards: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for b in batches:
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            shard, grown = jump(keys, shards), jump(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            s = shard[order]
            first = np.searchsorted(s, s, side="left")
            seq = np.empty(len(s), dtype=np.int64)
            seq[order] = np.arange(len(s)) - first + seen[s]
            seen += np.bincount(shard, minlength=shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(seq), pa.array(grown), pa.array(np.full(len(s), part, dtype=np.int32))], [*b.schema.names, "shard", "seq", "grown_shard", "part"])

    return run


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "narrow")
    by = ["doc_id", "text_crc32", "size", "row"]
    ranged = narrow.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stage(ranged.drop("row").mapInArrow(_number(shards), "doc_id long, size long, text_crc32 long, shard int, seq long, grown_shard int, part int"), "numbered")
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "shard", before.alias("base"))  # a row for each partition and shard, not for each document
    return rows.join(offsets, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("seq")).alias("slot"), "grown_shard")
