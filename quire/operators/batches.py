"""Running kernels over Arrow batches: one document in, rows out, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

CHUNK_ROWS, CHUNK_BYTES, PART_BYTES = 4096, 4 << 20, 4 << 20
#: Rows of a chunk with those of repeated documents. Documents of up to KEPT_BYTES and KEPT_ROWS rows are kept for later batches, HELD_BYTES and HELD_ROWS of them.
MOST_ROWS, KEPT_BYTES, KEPT_ROWS, HELD_BYTES, HELD_ROWS = 65536, 16 << 10, 64, 8 << 20, 32768
ERROR = "struct<kind:string,offset:bigint,message:string>"


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Numbers of rows, equal where all columns are."""
    out = np.zeros(n, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        out = np.unique(out * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)[1]
    return out


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Batches in parts of about PART_BYTES: what is made of one is as small, however long its documents are."""
    for b in batches:
        step = max(1, b.num_rows * PART_BYTES // max(PART_BYTES, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class Chunk:
    """Rows of documents, those of equal documents once, and where each document's lie."""

    def __init__(self):
        self.tails: list[tuple] = []
        self.found: dict[int, tuple[int, int, int]] = {}
        self.picked: list[tuple[int, int, int]] = []
        self.n = self.bytes = 0

    def pick(self, row: int, start: int, stop: int, size: int) -> None:
        self.picked.append((row, start, stop))
        self.n += stop - start
        self.bytes += size

    def full(self) -> bool:
        return self.n >= MOST_ROWS or self.bytes >= CHUNK_BYTES

    def record(self, ids: pa.Array, types: list) -> pa.RecordBatch:
        row, start, stop = np.array(self.picked, np.int64).T
        many = stop - start
        arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*self.tails, strict=True), types[1:], strict=True)]
        if len(self.tails) != self.n:
            at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(self.n)
            arrays = [a.take(pa.array(at)) for a in arrays]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(row, many))).cast(types[0][1]), *arrays], names=[n for n, _ in types])


def map_documents(files: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str, inputs: list[str], weight: Callable[[tuple], int] | None = None, once: bool = True) -> DataFrame:
    """rows(*inputs) for each row of files: tuples of schema. Columns other than inputs never reach Python.

    The first input names the document, and is the first column of its rows; all else of them comes from the other inputs. So documents that are equal
    in those are worked on once in a chunk, and small ones once in a task, unless `once` is false, for rows that are measurements.
    """
    struct: StructType = _parse_datatype_string(schema)  # type: ignore[assignment]
    types = [(f.name, to_arrow_type(f.dataType)) for f in struct.fields]

    def run(batches):
        kept: dict[tuple, tuple[list, int]] = {}
        kept_bytes = kept_rows = 0
        for b in sliced(batches):
            ids, cols = b.column(0), b.columns[1:]
            codes = _codes(cols, b.num_rows).tolist() if once else range(b.num_rows)
            chunk = Chunk()
            for i, code in enumerate(codes):
                if chunk.full():
                    yield chunk.record(ids, types)
                    chunk = Chunk()
                if code in chunk.found:
                    chunk.pick(i, *chunk.found[code])
                    continue
                values = tuple(c[i].as_py() for c in cols)
                start = len(chunk.tails)
                size, whole = 0, True
                if once and values in kept:
                    tails, size = kept[values]
                    chunk.tails += tails
                else:
                    for row in rows(ids[i].as_py(), *values):
                        chunk.tails.append(row[1:])
                        size += weight(row) if weight else 0
                        if len(chunk.tails) >= CHUNK_ROWS or chunk.bytes + size >= CHUNK_BYTES:
                            chunk.pick(i, start, len(chunk.tails), size)
                            yield chunk.record(ids, types)
                            chunk, start, size, whole = Chunk(), 0, 0, False
                    held = size + sum(len(v) for v in values if isinstance(v, (bytes, str)))
                    if once and whole and held <= KEPT_BYTES and len(chunk.tails) - start <= KEPT_ROWS:
                        if kept_bytes + held > HELD_BYTES or kept_rows + len(chunk.tails) - start > HELD_ROWS:
                            kept, kept_bytes, kept_rows = {}, 0, 0
                        kept[values] = chunk.tails[start:], size
                        kept_bytes, kept_rows = kept_bytes + held, kept_rows + len(chunk.tails) - start
                if len(chunk.tails) > start:
                    chunk.pick(i, start, len(chunk.tails), size)
                if once and whole:
                    chunk.found[code] = start, len(chunk.tails), size
            if chunk.n:
                yield chunk.record(ids, types)

    return files.select(*inputs).mapInArrow(run, struct)


def map_columns(files: DataFrame, rows: Callable[[object], tuple[int, list]], schema: str, inputs: list[str]) -> DataFrame:
    """rows(content) for each document of two inputs, its name and its content: the number of its rows and the columns of schema after the first.

    For many short documents that mostly differ: columns are joined instead of rows. Equal documents of a part are worked on once.
    """
    struct: StructType = _parse_datatype_string(schema)  # type: ignore[assignment]
    types = [(f.name, to_arrow_type(f.dataType)) for f in struct.fields]

    def run(batches):
        for b in sliced(batches):
            coded = b.column(1).dictionary_encode(null_encoding="encode")
            codes, values, at = coded.indices.to_numpy(), coded.dictionary, 0
            again = np.bincount(codes, minlength=len(values)) > 1
            kept: dict[int, tuple[int, list]] = {}
            held = 0
            while at < b.num_rows:
                sizes: list[int] = []
                columns: list[list] = [[] for _ in types[1:]]
                start, n = at, 0
                while at < b.num_rows and n < MOST_ROWS:
                    code = codes[at]
                    found = kept.get(code)
                    if found is None:
                        found = rows(values[code].as_py())
                        if again[code] and held + found[0] <= HELD_ROWS:
                            kept[code] = found
                            held += found[0]
                    for c, more in zip(columns, found[1], strict=True):
                        c.extend(more)
                    sizes.append(found[0])
                    n += found[0]
                    at += 1
                where = pa.array(np.repeat(np.arange(start, at), sizes))
                arrays = [b.column(0).take(where).cast(types[0][1]), *(pa.array(c, t) for c, (_, t) in zip(columns, types[1:], strict=True))]
                whole = pa.RecordBatch.from_arrays(arrays, names=[x for x, _ in types])
                for i in range(0, n, MOST_ROWS):
                    yield whole.slice(i, MOST_ROWS)

    return files.select(*inputs).mapInArrow(run, struct)


def with_password(files: DataFrame) -> DataFrame:
    return files if "password" in files.columns else files.withColumn("password", F.lit(None).cast("binary"))
