from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from quire.llm import op3_shards as op

from .helpers import frame


def jump(key: int, n: int) -> int:
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = [*range(-50, 2000), 2**62, -(2**63), 2**63 - 1]
    for n in (1, 2, 24, 25):
        assert op.jump(np.array(keys), n).tolist() == [jump(k, n) for k in keys]


def test_law(spark):
    texts = {i: "é" * (i % 50) for i in range(3000)} | {9001: None, 9002: ""}
    got = op.shard(frame(spark, texts), 24).collect()
    assert len(got) == len(texts)
    slots: dict = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(raw) + 8, zlib.crc32(raw), "key", jump(r.doc_id, 24))
        assert r.grown_shard == jump(r.doc_id, 25) and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append((r.doc_id, r.slot))
    for rows in slots.values():
        assert [s for _, s in sorted(rows)] == list(range(len(rows)))


def test_repeated_and_null_keys(spark):
    got = op.shard(frame(spark, [(5, "x")] * 300 + [(None, "y")] * 200 + [(5, "z")]), 24).collect()
    by = Counter((r.doc_id, r.shard) for r in got)
    assert by == {(5, jump(5, 24)): 301, (None, jump(0, 24)): 200}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert op.shard(frame(spark, {}), 24).count() == 0


def test_sql_columns(spark, sf):
    import duckdb
    from quire.llm.catalogue import OP3_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(OP3_SQL).fetchall())
    got = op.shard(spark.read.parquet(f"{sf}/documents.parquet"), 24).collect()
    assert sorted(map(tuple, got)) == want
