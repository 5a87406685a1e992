"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition packs its pieces best-fit decreasing, a run of RUN_PIECES at a time. Sequences within NEAR tokens of full are final. The rest is the
residue: its underfull sequences are taken apart again, so that each is one piece, and go up as items of the next round. Pieces of one length are
interchangeable, so what goes up a tree of partial sums is how many items of each length there are; its root holds at most
one count a length, whatever the input, and packs all residues together, best-fit decreasing again, some thousand equal items at a time.
Which items of a length go to which sequences is a few ranges of their numbers, and an item's number is its place among those of
its length in its partition, plus a prefix sum over the partitions before. So nothing is closed early to keep a node small, and
no sequence is short of global best-fit by more than the NEAR tokens of the final ones.

Only documents longer than a sequence are cut; the first piece is then the shorter one, so that all others are full.

Nulls and odd cases: a null or empty text is its end token alone; a null doc_id is kept; repeated rows are packed each; an
empty table gives no rows; texts of any length are tokenised whole; special-token strings in a text are what tokenizers makes of them
by default, the special token; other columns are not looked at.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

CAPACITY, END, NEAR = 1024, 2, 4
#: A run of a partition that is packed as one node.
RUN_PIECES, RUN_TOKENS = 1 << 16, 1 << 24
#: An item of the root is length << NUMBER | its number among those of its length.
NUMBER = 44
_encoders: dict = {}


def encoder(path: str):
    """A function from a text to the ids of the tokenizers file at path, as encode(text, add_special_tokens=False) gives them.

    The same ranks and pattern run in tiktoken, which is several times as fast; texts beyond its comfort or with the string of a special token, and
    files that are not a byte-level BPE, go to tokenizers itself. A test holds the two against each other.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        fast = None
        pre = spec.get("pre_tokenizer") or {}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
            ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if fast is None or len(text) > 1_000_000 or any(t in text for t in special):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: best-fit decreasing, ties in the given order."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            left = s + (fit & -fit).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            k, left = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = k, fills[k]
        fills[k] += s
        left -= s
        if left:
            room[left].append(k)
            mask |= 1 << left
    return where, offset, np.array(fills, dtype=np.int64)


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """best_fit for counts[size] items of each size: (size, number of the first item, first bin, items a bin, offset) of stretches of items.

    Equal items fill bins of equal room alike, so a step places as many as there are such bins; steps follow distinct sizes and rooms.
    """
    out, bins = [], 0
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # stretches (first, number) of bins with so much room
    mask = 0

    def put(left: int, first: int, n: int) -> None:
        nonlocal mask
        if n and left:
            room[left].append((first, n))
            mask |= 1 << left

    for size in sorted(counts, reverse=True):
        number, todo = 0, counts[size]
        while todo:
            fit = mask >> size
            if fit:
                left = size + (fit & -fit).bit_length() - 1
                first, n = room[left].pop()
                if not room[left]:
                    mask ^= 1 << left
            else:
                left, first, n = capacity, bins, -(-todo // (capacity // size))
                bins += n
            each = left // size
            whole = min(n, todo // each)
            if whole:
                out.append((size, number, first, each, capacity - left))
                put(left - each * size, first, whole)
                number, todo = number + whole * each, todo - whole * each
            if whole < n and todo:  # fewer than one bin takes
                out.append((size, number, first + whole, todo, capacity - left))
                put(left - todo * size, first + whole, 1)
                whole, todo = whole + 1, 0
            put(left, first + whole, n - whole)
    return out


def _local(path: str, capacity: int, end: int, with_ids: bool):
    def flush(part, run, seen, ids, pieces, starts, sizes, tokens):
        sizes = np.array(sizes, dtype=np.int64)
        where, offset, fills = best_fit(sizes, capacity)
        live = fills[where] < capacity - NEAR
        order = np.argsort(sizes[live], kind="stable")
        n = sizes[live][order]
        number = np.zeros(len(sizes), dtype=np.int64)
        number[np.flatnonzero(live)[order]] = seen[n] + np.arange(len(n)) - np.searchsorted(n, n)
        seen += np.bincount(n, minlength=len(seen))
        crc = np.array([zlib.crc32(t) for t in tokens], dtype=np.int64)
        key = (np.int64(part) << 36) + (np.int64(run) << 20) + where
        cols = [pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes), pa.array(crc), pa.array(key), pa.array(offset), pa.array(live), pa.array(np.full(len(sizes), part)), pa.array(number)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open", "part", "number"]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(tokens), dtype="<u4").astype(np.int32))))
            names.append("ids")
        table = pa.Table.from_arrays(cols, names)
        return table.to_batches(max_chunksize=8192)

    def run(batches):
        encode, part, n = encoder(path), TaskContext.get().partitionId(), 0
        seen = np.zeros(capacity + 1, dtype=np.int64)
        held: tuple[list, ...] = ([], [], [], [], [])
        total = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = np.array([*(encode(text) if text else ()), end], dtype="<u4")
                cut = [0, *range(len(t) % capacity or capacity, len(t), capacity), len(t)]
                for k in range(len(cut) - 1):
                    for to, x in zip(held, (i, k, cut[k], cut[k + 1] - cut[k], t[cut[k] : cut[k + 1]].tobytes()), strict=True):
                        to.append(x)
                total += len(t)
                if len(held[0]) >= RUN_PIECES or total >= RUN_TOKENS:
                    yield from flush(part, n, seen, *held)
                    held, total, n = ([], [], [], [], []), 0, n + 1
        if held[0]:
            yield from flush(part, n, seen, *held)

    return run


def _placer(stretches: list[tuple[int, int, int, int, int]]):
    size, number, first, each, offset = np.array(sorted(stretches), dtype=np.int64).reshape(-1, 5).T
    start = size << NUMBER | number

    def run(batches):
        for b in batches:
            names = b.schema.names
            length, item = (b.column(names.index(c)).to_numpy() for c in ("length", "item"))
            k = np.searchsorted(start, length << NUMBER | item, side="right") - 1
            at = item - number[k]
            own = {"sequence_id": pa.array(-1 - (first[k] + at // each[k])), "offset": pa.array(offset[k] + at % each[k] * length)}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else b.column(i) for i, c in enumerate(names) if c != "item"], [c for c in names if c != "item"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for. Sequences of the root have negative numbers."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, part long, number long" + ", ids array<int>" * with_ids
    rows = stage(src.mapInArrow(_local(tokenizer_path, capacity, end, with_ids), schema), "pieces")
    residue = rows.where("open")
    counts = stage(residue.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most one row a length
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = residue.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), ["part", "length"])
    items = numbered.select(*names, (F.col("base") + F.col("number")).alias("item"))
    out = rows.where("not open").select(names)
    return out.unionByName(items.mapInArrow(_placer(best_fit_counts(total, capacity)), rows.select(names).schema))
