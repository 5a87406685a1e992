"""What several operators share: staged tables, connected components and word-shingle hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are hashed a slice of text at a time, so that memory does not follow the batch.
SLICE_BYTES = 1 << 20
#: Edges that one task may hold at once.
EDGES = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[str, np.ndarray] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of our own on this machine, if all executors are in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The folder goes by unstage, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = at  # type: ignore[attr-defined]
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables of which all that is still to be read has been staged itself."""
    for t in tables:
        at = t.staged_at  # type: ignore[attr-defined]
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return nodes, nodes[low]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != (up := low[low])).any():
            low = up


def _contract(batches):
    """Stars with the same components as the edges of a partition, EDGES of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def stars():
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        nodes, low = roots(u, v)
        some = nodes != low
        return nodes[some], low[some]

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= 2 * EDGES:
            held = [stars()]
            size = len(held[0][0])
            if size >= EDGES:  # contracting again would gain little
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars()], ["u", "v"])


def _label(batches):
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*(np.concatenate([e[i] for e in edges]) for i in (0, 1)))], ["id", "component"])


def _rooted(hook: DataFrame) -> DataFrame:
    """hook(u, to) with every to at the end of its way: pointers are doubled until none moves."""
    while True:
        further = hook.select(F.col("u").alias("to"), F.col("to").alias("next"))
        doubled = hook.join(further, "to").select("u", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        hook, before = stage(doubled, "hooks"), hook
        unstage(before)
        if hook.where("moved").isEmpty():
            return hook.select("u", "to")


def components(edges: DataFrame, bound: int = EDGES) -> DataFrame:
    """(id, component) of each node of edges(a, b): component is the smallest id reachable.

    Every partition first contracts its edges to stars. While more than bound edges are left, a round of hooking contracts
    the graph across partitions: each node hooks to the smallest node next to it, if that is smaller, hooks are followed to their roots
    by doubling, and roots stand for their trees. Two rounds halve the nodes of a component at least: roots have no
    roots next to them, so either at most half of the nodes are roots, or fewer than half are not; and a root that stays one in the
    second round has all nodes next to it in its own tree, so that there are at most as many as there were other nodes. Rounds are equi-joins and partial aggregates.
    What is left, at most bound edges, is labelled by one task, and the rounds are undone by a join each. Rounds are staged;
    nothing but a count comes to the driver.
    """
    now = stage(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_contract, "u long, v long"), "stars")
    rounds = []
    while now.count() > bound:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = _rooted(stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), "hooks"))
        rounds.append(hook)
        moved = now.join(hook.withColumnRenamed("to", "a"), "u").join(hook.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").where("a <> b")
        moved = moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        now, before = stage(moved.mapInArrow(_contract, "u long, v long"), "stars"), now
        unstage(before)
    out = now.repartition(1).mapInArrow(_label, "id long, component long")
    for hook in reversed(rounds):
        known = stage(out, "labels").withColumnRenamed("id", "to")
        out = hook.join(known, "to", "left").select(F.col("u").alias("id"), F.coalesce("component", "to").alias("component"))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        up = np.full(size, _P, dtype=np.uint64)
        down = np.full(size, _P_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["p"], _powers["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["p"], _powers["q"]


def slices(texts: list):
    """Ranges of texts of about SLICE_BYTES each; a longer text stands alone, whole."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z lower-cased, and the index of each one's text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return h, np.searchsorted(first, starts, side="right") - 1


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; fewer words count as one shingle, no word as none."""
    h, doc = words(texts)
    n = len(h)
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    if n >= k:
        g = h[: n - k + 1].copy()
        for j in range(1, k):
            g = g * _STEP + h[j : n - k + 1 + j]
        g = mix(g)
    out = []
    for i in range(len(texts)):
        lo, hi = bound[i], bound[i + 1]
        if hi - lo >= k:
            out.append(np.unique(g[lo : hi - k + 1]))
        elif hi > lo:
            x = np.array([hi - lo], dtype=np.uint64)  # as an array it wraps around silently
            for y in h[lo:hi]:
                x = x * _STEP + y
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
