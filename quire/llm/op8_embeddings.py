"""Embedding near-duplicates within a label: a subspace pigeonhole join.

For unit vectors cosine >= t means a squared distance of at most 2 (1 - t). Vectors are rotated by a fixed random orthogonal
matrix and split into BLOCKS low-dimensional blocks; if the whole squared distance keeps its budget, at least one block
keeps a share of it in proportion to its dimensions. So a range join of every block under its own budget finds every link,
and each candidate is verified by the exact cosine of the original vectors in double precision.

A block is range-joined on a grid over its first two rotated coordinates, with cells twice as wide as the block's radius: a row
is at home in its cell and visits a later neighbouring cell only if it is within the radius of it. A cell with many rows is
dealt in chunks of CHUNK, and every pair of chunks is a task of its own, so no task holds more than two chunks.
Rotated coordinates are rounded to integers, on which block distances are exact, so that a pair that several blocks find
is counted by the first of them alone; two visitors of a cell are no pair of it. Links are counted where they are found and leave a task only as a count for
each vector and as spanning edges, never as all pairs of a group.

Equal vectors of a label are one class, with a count, from the start.

Nulls and odd cases: a vector that is null, zero or holds null or non-finite components, a null label, or a null id links
with nothing; it is its own component (null for a null id) and is kept; vectors of fewer components count as filled up with zeros;
repeated rows count as rows, each a link of the others; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, stage
from .vectors import matrix, unpack

BLOCKS, CHUNK, SCALE, SIDE = 8, 4096, 1 << 20, 2.0
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))
        _rotations[dim] = q * np.sign(np.diag(r))
    return _rotations[dim]


def layout(dim: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first, end, radius) of each block; radii have room for rounding."""
    n = min(BLOCKS, dim)
    cuts = [dim * i // n for i in range(n + 1)]
    budget = 2 * (1 - threshold)
    return [(a, z, float(np.sqrt(budget * (z - a) / dim)) + 2.0 * np.sqrt(z - a) / SCALE) for a, z in zip(cuts, cuts[1:], strict=False)]


def rotated(x: np.ndarray) -> np.ndarray:
    """Rounded rotated unit vectors, row by row the same whatever the batch."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.rint(np.einsum("ij,jk->ik", unit, rotation(x.shape[1]), optimize=False) * SCALE)


def _encode(batches):
    for b in batches:
        rows, x = matrix(b.column(2))
        top = np.abs(x).max(axis=1, initial=0)
        rows, x, top = rows[top > 0], x[top > 0], top[top > 0]
        small = x.astype(np.float32)
        exact = bool((small.astype(np.float64) == x).all())  # floats travel as floats
        scale = np.where((top > 1e100) | (top < 1e-100), top, 1.0)[:, None]  # squares would overflow or vanish
        if exact and (scale == 1).all():
            blobs = [b"f" + r.tobytes() for r in small]
        else:
            blobs = [b"d" + r.tobytes() for r in x / scale]
        value = np.full(b.num_rows, None, dtype=object)
        value[rows] = blobs
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(value, pa.binary())], ["vec_id", "label", "v"])


def decode(blobs, dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        r = np.frombuffer(b, dtype=np.float32 if b[:1] == b"f" else np.float64, offset=1)
        out[i, : len(r)] = r
    return out


def _cells(dim: int, threshold: float):
    plan = layout(dim, threshold)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r = rotated(decode(b.column(2).to_pylist(), dim)) / SCALE
            at, block, cx, cy, home = [], [], [], [], []
            for k, (a, z, radius) in enumerate(plan):
                side = SIDE * radius
                x = r[:, a] / side
                y = r[:, a + 1] / side if z - a > 1 else np.zeros(len(r))
                fx, fy = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
                reach = 1 / SIDE + 1e-9
                for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
                    gap_x = np.zeros(len(r)) if dx == 0 else fx + 1 - x
                    gap_y = np.zeros(len(r)) if dy == 0 else (fy + 1 - y if dy > 0 else y - fy)
                    i = np.flatnonzero((gap_x <= reach) & (gap_y <= reach))
                    at.append(i)
                    block.append(np.full(len(i), k))
                    cx.append(fx[i] + dx)
                    cy.append(fy[i] + dy)
                    home.append(np.full(len(i), dx == 0 and dy == 0))
            i = pa.array(np.concatenate(at))
            cols = [b.column(0).take(i), b.column(1).take(i), pa.array(np.concatenate(block).astype(np.int32)), pa.array(np.concatenate(cx)), pa.array(np.concatenate(cy)), pa.array(np.concatenate(home)), b.column(2).take(i), b.column(3).take(i)]
            whole = pa.Table.from_arrays(cols, ["rep", "label", "block", "cx", "cy", "home", "v", "many"])
            yield from whole.to_batches(max_chunksize=8192)

    return run


def _within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
    return d <= (radius * SCALE) ** 2


def spanning(low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Indices of edges (u, v) that suffice to join what all of them do; low, the least node of each node's component, follows."""
    used, left = [np.zeros(0, np.int64)], np.arange(len(u))
    while True:
        x, y = low[u[left]], low[v[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(used)
        high, first = np.unique(np.maximum(x, y), return_index=True)
        # every component that is not the least of its edge hooks to a lesser one by one edge, so no cycle closes
        low[high] = np.minimum(x, y)[first]
        used.append(left[first])
        while (low != (up := low[low])).any():
            low[:] = up


def _joiner(dim: int, threshold: float):
    plan = layout(dim, threshold)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, i, j = int(key[1]), int(key[4]), int(key[5])
        pdf = pdf.sort_values(["chunk", "rep"], ignore_index=True)
        ids, many, home, chunk = (pdf[c].to_numpy() for c in ("rep", "many", "home", "chunk"))
        v = decode(pdf["v"].tolist(), dim)
        r = rotated(v)
        left, right = (np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
        links, edges = np.zeros(len(ids), np.int64), []
        low = np.arange(len(ids))  # the least row that each row is known to be linked to
        norm = np.sqrt((v * v).sum(axis=1))

        def linked(p: np.ndarray, q: np.ndarray) -> None:
            found = spanning(low, p, q)
            edges.append(np.stack((ids[p[found]], ids[q[found]])))

        def by_pairs(p: np.ndarray, q: np.ndarray) -> None:
            """Few candidates of a stretch of rows: each by itself."""
            new = np.ones(len(p), dtype=bool)
            for a, z, radius in plan[:block]:
                new &= ((r[p, a:z] - r[q, a:z]) ** 2).sum(axis=1) > (radius * SCALE) ** 2
            p, q = p[new], q[new]
            hit = np.einsum("ij,ij->i", v[p], v[q]) / (norm[p] * norm[q]) >= threshold
            p, q = p[hit], q[hit]
            np.add.at(links, p, many[q])
            np.add.at(links, q, many[p])
            linked(p, q)

        def by_matrix(rows: np.ndarray, cols: np.ndarray, ok: np.ndarray) -> None:
            """Near copies of each other: all by products of matrices."""
            for a, z, radius in plan[:block]:
                ok &= ~_within(r[rows, a:z], r[cols, a:z], radius)
            x, y = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            p, q = rows[x], cols[y]
            cos = (v[p] @ v[q].T) / (norm[p][:, None] * norm[q])
            hit = ok[np.ix_(x, y)] & (cos >= threshold)
            links[p] += hit @ many[q]
            links[q] += many[p] @ hit
            f, g = np.nonzero(hit & (low[p][:, None] != low[q]))
            linked(p[f], q[g])

        # two visitors of a cell are not its pair
        sides = [(left[home[left]], right)] + ([(left[~home[left]], right[home[right]])] if i != j else [])
        for whole, cols in sides:
            for lo in range(0, len(whole), 512):
                rows = whole[lo : lo + 512]
                a, z, radius = plan[block]
                ok = _within(r[rows, a:z], r[cols, a:z], radius)
                if i == j:
                    ok &= ~home[cols] | (rows[:, None] < cols)
                if 16 * np.count_nonzero(ok) > ok.size:
                    by_matrix(rows, cols, ok)
                    continue
                p, q = np.nonzero(ok)
                for at in range(0, len(p), 1 << 15):
                    by_pairs(rows[p[at : at + (1 << 15)]], cols[q[at : at + (1 << 15)]])
        some = np.flatnonzero(links)
        out = pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "n": links[some]})
        if edges:
            e = pd.DataFrame(np.concatenate(edges, axis=1).T, columns=["a", "b"]).astype({"b": "Int64"})
            e["n"] = 0
            out = pd.concat([out, e])
        return out

    return join


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors; see the module for the method and odd cases."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("e"))
    dim = int(src.agg(F.max(F.size("e"))).first()[0] or 0)
    rows = stage(src.mapInArrow(_encode, "vec_id long, label string, v binary"), "vectors")
    classes = stage(rows.where("vec_id is not null and label is not null and v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    cells = stage(classes.select("rep", "label", "v", "many").mapInArrow(_cells(max(dim, 1), threshold), "rep long, label string, block int, cx long, cy long, home boolean, v binary, many long"), "cells")
    cell = ["label", "block", "cx", "cy"]
    sizes = cells.groupBy(*cell).agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").select(*cell, F.ceil(F.col("n") / CHUNK).alias("chunks"))
    dealt = cells.join(sizes, cell).withColumn("chunk", F.expr("pmod(xxhash64(rep), chunks)"))
    tasks = dealt.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(
        *cell, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "home", "v", "many", "chunk"
    )
    found = stage(tasks.groupBy(*cell, "i", "j").applyInPandas(_joiner(max(dim, 1), threshold), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    of_class = classes.join(counts, "rep", "left").join(groups, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(of_class, ["label", "v"], "left").withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")))
    return out.select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
