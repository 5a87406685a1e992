"""Exact top-k by inner product: a Voronoi kNN join.

Components are floor(256 * x). The inner product becomes a distance by one added component: data vectors get
sqrt(M^2 - |y|^2), M the largest norm, queries get 0; then |q' - y'|^2 = |q|^2 + M^2 - 2 q.y, so the nearest are the best.

Pivots (at most PIVOTS centres of a sample of at most SAMPLE rows, those of the smallest hashed ids) split data and queries into Voronoi groups. A query is
first solved in the data group of its own pivot, which gives it a radius, the distance of its k-th neighbour there; if that group holds fewer,
the summaries do, which are each data group's k + 1 smallest distances to its pivot. From the radii every query group has bounds on the
distance to each pivot, outside of which no data row can be a neighbour of any of its queries. Data rows are replicated only to the query groups
whose bounds hold them for all pivots. Groups are solved locally in cells of bounded size, queries in blocks of QUERIES and data in
chunks of ROWS, so that neither a large group nor equal vectors meet in one task; a query's k best of each cell are merged at the end.

Of equal vectors those of the k + 1 smallest ids can matter, one of which may be the query's own, and k rows of an id. Only they are candidates,
so a vector that a third of all rows have is as any other.

Nulls and odd cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
vectors of fewer components count as filled up with zeros; rows that repeat an id are candidates each, for queries of other ids, and a query id's
rows share its k best; with fewer than k other rows all of them are returned; ties go to the smaller id; an empty table gives no rows. Scores are exact while
they fit in a long. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage
from .vectors import matrix, unpack

PIVOTS, QUERIES, ROWS, PER_PIVOT, SAMPLE = 128, 512, 8192, 256, 4096
_SLACK = 1e-6


def _quantise(batches):
    for b in batches:
        rows, x = matrix(b.column(1))
        v = np.floor(256 * x).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in v], pa.binary()), pa.array((v.astype(np.float64) ** 2).sum(axis=1))],
            ["vec_id", "v", "n2"],
        )


def _thinner(k: int):
    """At most k rows of an id and vector in each batch."""

    def run(batches):
        for b in batches:
            met: dict = {}
            keep = []
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                met[row] = n = met.get(row, 0) + 1
                keep.append(n <= k)
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    dim = max(x.shape[1], pivots.shape[1])
    a, p = np.zeros((len(x), dim + 1)), np.zeros((len(pivots), dim + 1))
    a[:, : x.shape[1]], a[:, -1] = x, extra
    p[:, : pivots.shape[1]], p[:, -1] = pivots, pivot_extra
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * a @ p.T, 0))


def centres(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """At most n centres of the rows of x by a few rounds of k-means, started at distinct rows."""
    start = np.unique(x, axis=0)
    now = start[np.random.default_rng(3).permutation(len(start))[:n]]
    none = np.zeros(1)
    for _ in range(rounds):
        near = _distances(x, none.repeat(len(x)), now, none.repeat(len(now))).argmin(axis=1)
        many = np.bincount(near, minlength=len(now))
        total = np.zeros_like(now)
        np.add.at(total, near, x)
        now = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], now)
    return now


def _lifted(b: pa.RecordBatch, top2: float, as_query: bool) -> tuple[np.ndarray, np.ndarray]:
    names = b.schema.names
    x = unpack(b.column(names.index("v")).to_pylist(), np.int64).astype(np.float64)
    return x, np.zeros(len(x)) if as_query else np.sqrt(np.maximum(top2 - b.column(names.index("n2")).to_numpy(), 0))


def _assigner(pivots: np.ndarray, pivot_extra: np.ndarray, top2: float, as_query: bool):
    def run(batches):
        for b in batches:
            if b.num_rows:
                d = _distances(*_lifted(b, top2, as_query), pivots, pivot_extra)
                near = d.argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(d[np.arange(len(d)), near])], [*b.schema.names, "g", "d"])

    return run


def _bounder(pivots: np.ndarray, pivot_extra: np.ndarray, top2: float, k: int, by_summary: dict[int, float]):
    """Bounds of a batch's queries by group: least and greatest distance to each pivot, their radii taken off and added."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(*_lifted(b, top2, True), pivots, pivot_extra)
            names = b.schema.names
            g, n2 = (b.column(names.index(c)).to_numpy() for c in ("g", "n2"))
            kth = b.column(names.index("kth")).to_numpy(zero_copy_only=False).astype(np.float64)  # null, fewer than k, as NaN
            radius = np.sqrt(np.maximum(n2 + top2 - 2 * kth, 0))
            most = np.array([by_summary.get(i, np.inf) for i in g.tolist()])
            radius = np.fmin(radius, most)[:, None]
            radius = radius + _SLACK * (1 + radius + d)
            order = np.argsort(g, kind="stable")
            ids, first = np.unique(g[order], return_index=True)
            lo, hi = np.minimum.reduceat((d - radius)[order], first), np.maximum.reduceat((d + radius)[order], first)
            n = d.shape[1]
            cols = [np.repeat(ids, n).astype(np.int32), np.tile(np.arange(n, dtype=np.int32), len(ids)), lo.ravel(), hi.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["qg", "j", "lo", "hi"])

    return run


def _replicator(pivots: np.ndarray, pivot_extra: np.ndarray, top2: float, groups: list[int], lo: np.ndarray, hi: np.ndarray):
    """(qg, vec_id, v) of each data row for every other query group whose bounds hold it."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(*_lifted(b, top2, False), pivots, pivot_extra)
            own = b.column(b.schema.names.index("g")).to_numpy()
            for i, g in enumerate(groups):
                at = np.flatnonzero((own != g) & (d >= lo[i]).all(axis=1) & (d <= hi[i]).all(axis=1))
                if len(at):
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, dtype=np.int32)), b.column(0).take(rows), b.column(1).take(rows)], ["qg", "vec_id", "v"])

    return run


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, v))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * dim
    if most < 2**53:  # doubles hold every partial sum exactly
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _solver(k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id")
            ids, v, q, asked = data["vec_id"].to_numpy(), unpack(data["v"], np.int64), unpack(queries["v"], np.int64), queries["vec_id"].to_numpy()
            for lo in range(0, len(q), 128):
                s = _products(q[lo : lo + 128], v)
                for me, row in zip(asked[lo : lo + 128], s, strict=True):
                    other = np.flatnonzero(ids != me)
                    row = row[other]
                    at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    at = at[np.argsort(-row[at], kind="stable")[:k]]  # ids rise, so ties go to the smaller
                    out.append((np.full(len(at), me), ids[other[at]], row[at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return solve


def _solved(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of each query's k best in every cell: queries(qg, vec_id, v) of a group against data(qg, vec_id, v) of it."""
    n = data.groupBy("qg").agg(F.ceil(F.count("*") / ROWS).alias("chunks")).join(queries.groupBy("qg").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "qg")
    per_group = F.broadcast(n)  # at most PIVOTS rows
    rows = data.join(per_group, "qg").select("qg", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("qb"), F.expr("pmod(xxhash64(vec_id), chunks)").alias("chunk"), "vec_id", "v")
    ask = queries.join(per_group, "qg").select("qg", F.expr("pmod(xxhash64(vec_id, v), blocks)").alias("qb"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "vec_id", "v")
    cell = ["qg", "qb", "chunk"]
    return ask.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(_solver(k), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def prepared(vectors: DataFrame, k: int, id_col: str, vector_col: str, every: int) -> tuple[DataFrame, DataFrame]:
    """Queries, and the rows that can be among the k best of any of them, as staged vec_id, v, n2."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).where("vec_id is not null")
    rows = stage(src.mapInArrow(_quantise, "vec_id long, v binary, n2 double"), "vectors")
    # one shuffle by vector: group limits thin a frequent vector before it, and the second window finds its rows together
    first = rows.mapInArrow(_thinner(k), rows.schema).withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"r <= {k + 1}").drop("r")
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("n2"))).where(f"r <= {k}").drop("r")
    return rows.where(F.col("vec_id") % every == 0), stage(first, "candidates")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best others for each row whose id is divisible by every."""
    asked, data = prepared(vectors, k, id_col, vector_col, every)
    top2, n = data.agg(F.coalesce(F.max("n2"), F.lit(0.0)), F.count("*")).first()
    wanted = int(min(PIVOTS, max(1, asked.count() // PER_PIVOT)))
    # about 4 SAMPLE rows pass the hash, so that partitions hand few to the driver, however many there are
    some = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * SAMPLE / max(n, 1)))
    sample = data.where(some).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    pivots = centres(unpack([r.v for r in sample], np.int64).astype(np.float64), wanted) if sample else np.zeros((1, 1))
    extra = np.sqrt(np.maximum(top2 - (pivots**2).sum(axis=1), 0))
    schema = "vec_id long, v binary, n2 double, g int, d double"
    grouped = stage(data.mapInArrow(_assigner(pivots, extra, top2, False), schema), "data")
    queries = stage(asked.mapInArrow(_assigner(pivots, extra, top2, True), schema), "queries")
    as_group = F.col("g").alias("qg")
    ask = queries.select(as_group, "vec_id", "v")
    near = stage(_solved(ask, grouped.select(as_group, "vec_id", "v"), k), "near")

    # summaries: k + 1 rows of different ids for each pivot; at most one of them is a query's own
    nearest = grouped.groupBy("g", "vec_id").agg(F.min("d").alias("d"))
    nearest = nearest.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("d", "vec_id"))).where(f"r <= {k + 1}")
    lows: dict[int, list[float]] = {}
    for r in nearest.select("g", "d").collect():
        lows.setdefault(r.g, []).append(r.d)
    between = _distances(pivots, extra, pivots, extra)
    by_summary = {}
    for i, farthest in ((r.g, r.d) for r in queries.groupBy("g").agg(F.max("d").alias("d")).collect()):
        reach = sorted(farthest + between[i, j] + d for j, ds in lows.items() for d in ds)
        if len(reach) > k:
            by_summary[i] = reach[k]
    kth = _best(near, k).where(f"rank = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    bounds = queries.join(kth, "vec_id", "left").select("vec_id", "v", "n2", "g", "kth").mapInArrow(_bounder(pivots, extra, top2, k, by_summary), "qg int, j int, lo double, hi double")
    table = bounds.groupBy("qg", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # at most PIVOTS ** 2 rows
    groups = sorted({r.qg for r in table})
    lo, hi = (np.zeros((len(groups), len(pivots))) for _ in range(2))
    for r in table:
        lo[groups.index(r.qg), r.j], hi[groups.index(r.qg), r.j] = r.lo, r.hi
    far = stage(grouped.select("vec_id", "v", "n2", "g").mapInArrow(_replicator(pivots, extra, top2, groups, lo, hi), "qg int, vec_id long, v binary"), "replicated")
    return _best(near.unionByName(_solved(ask, far, k)), k)
