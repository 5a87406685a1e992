"""Language-model scores by context-tree weighting over binary-decomposed byte contexts.

A text is its UTF-8 bytes and one end symbol (0xFF, which UTF-8 never has), after DEPTH end symbols of context. A byte is
eight binary choices; the choice after a prefix of bits has a context tree of its own over the preceding bytes, up to
DEPTH of them. A node with a zeros and b ones has the Krichevsky-Trofimov estimate P_e(a, b) of its choices, and the weighted
probability P_w = 1/2 P_e + 1/2 (product of its children's P_w), P_e at the greatest depth. Counts come from the training
documents and are then fixed: a choice has the probability that weighting gives it next, with the weights and estimates
of the nodes on its path, so all depths are mixed. A node that training never reached has probability 1/2 and weight 1/2.

Everything is a relation: n-gram counts, nodes of each depth from the nodes one deeper by a group-by, and the mixture from
the root outwards by one equi-join a depth. The scan packs documents into blocks of about BLOCK bytes. A block asks for each
distinct n-gram and word of its texts once, gets their probabilities and counts by an equi-join, and streams its texts
against that dictionary. So nothing is broadcast, no table has to fit in one place, and rows follow distinct n-grams of
blocks, not text. Words and n-grams of words are known by 64-bit hashes; n-grams of bytes are exact.

base_score is the sum over words and one end of log10((c + 1) / (N + V + 1)), from all training tokens.

Nulls and odd cases: a null or empty text is its end alone; a null doc_id counts as the empty string in the fold;
repeated rows count as often as they come; without training documents all choices have probability 1/2; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op9_language import fold
from .shared import mix, slices, stage, unstage, words

#: PER_TASK is how many blocks a task of the scan streams, about.
DEPTH, BLOCK, PER_TASK = 4, 16 << 20, 8
END = 0xFF
END_TOKEN = -0x5D1AD0F4E3A1B2C7


def _packer(batches):
    """Blocks of (doc_id, held_out, text) in compressed blobs; part and number name a block."""
    from pyspark import TaskContext

    part, block, filled = TaskContext.get().partitionId(), 0, 0
    opts = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        texts = b.column(2).to_pylist()
        for lo, hi in slices(texts):
            piece = pa.table({"i": b.column(0).slice(lo, hi - lo), "h": b.column(1).slice(lo, hi - lo), "t": pa.array(texts[lo:hi], pa.large_string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=opts) as w:
                w.write_table(piece)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "blob"])
            filled += piece.nbytes
            if filled >= BLOCK:
                block, filled = block + 1, 0


def unpacked(blob: bytes) -> tuple[pa.Array, np.ndarray, list]:
    t = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return t.column("i").combine_chunks(), t.column("h").to_numpy(), t.column("t").to_pylist()


def byte_grams(texts: list, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte and its context, oldest byte first, and the number of each text's codes."""
    pad = bytes([END]) * depth
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\xff" for t in texts]
    buf = np.frombuffer(pad + pad.join(raw), dtype=np.uint8).astype(np.uint64)
    n = len(buf) - depth
    code = np.zeros(n, dtype=np.uint64)
    for i in range(depth + 1):
        code = (code << np.uint64(8)) | buf[i : i + n]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    # the padding between two texts is context, not text
    starts = np.cumsum(np.concatenate(([0], sizes[:-1] + depth)))
    keep = np.zeros(n, dtype=bool)
    flat = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    keep[flat] = True
    return code[keep], sizes


def _merge(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


def _asker(depth: int):
    """(block, kind, key, n) for every distinct n-gram (kind 0) and token (kind 1) of a block, n the training count."""

    def flush(block, held):
        for kind in (0, 1):
            k, n = _merge(*held[kind])
            for lo in range(0, len(k), 65536):
                part = slice(lo, lo + 65536)
                size = len(k[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int64)), pa.array(np.full(size, kind, np.int32)), pa.array(k[part]), pa.array(n[part])], ["block", "kind", "key", "n"])

    def run(batches):
        block, held = None, None
        for b in batches:
            for this, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if this != block:
                    if block is not None:
                        yield from flush(block, held)
                    block, held = this, (([], []), ([], []))
                _, out, texts = unpacked(blob.as_py())
                code, sizes = byte_grams(texts, depth)
                w, at = words(texts)
                at = out[at] if len(at) else np.zeros(0, bool)
                w = np.concatenate((w.view(np.int64), np.full(len(texts), END_TOKEN, np.int64)))
                for (keys, counts), x, skip in ((held[0], code.view(np.int64), np.repeat(out, sizes)), (held[1], w, np.concatenate((at, out)))):
                    for use in (False, True):
                        k, n = np.unique(x[skip == use], return_counts=True)
                        keys.append(k)
                        counts.append(np.zeros_like(n) if use else n)
                    if sum(map(len, keys)) > 4_000_000:
                        k, n = _merge(keys, counts)
                        keys[:], counts[:] = [k], [n]
        if block is not None:
            yield from flush(block, held)

    return run


def _log_gamma_half(n: Column) -> Column:
    """ln gamma(n + 1/2) for a whole n >= 0."""
    table = F.array(*(F.lit(math.lgamma(i + 0.5)) for i in range(16)))
    return F.when(n < 16, F.get(table, F.least(n, F.lit(15)).cast("int"))).otherwise(_stirling(n + 0.5))


def _log_factorial(n: Column) -> Column:
    table = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    return F.when(n < 16, F.get(table, F.least(n, F.lit(15)).cast("int"))).otherwise(_stirling(n + 1.0))


def _stirling(x: Column) -> Column:
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)


def _log_kt() -> Column:
    a, b = F.col("a"), F.col("b")
    return _log_gamma_half(a) + _log_gamma_half(b) - _log_factorial(a + b) - math.log(math.pi)


def model(grams: DataFrame, depth: int) -> DataFrame:
    """(key, lp), staged: log10 probability of the last byte of each n-gram after the others. grams: key, n."""
    bits = grams.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    bits = bits.select(
        "key",
        "n",
        F.expr("shiftleft(shiftrightunsigned(key, 8), 8) | (shiftleft(1L, i) | shiftright(key & 255, 8 - i))").alias("node"),
        F.expr("shiftright(key & 255, 7 - i) & 1").alias("bit"),
    )
    nodes = bits.groupBy("node").agg(F.sum(F.expr("if(bit = 0, n, 0)")).alias("a"), F.sum(F.expr("if(bit = 1, n, 0)")).alias("b"))
    level = stage(nodes.withColumn("pe", _log_kt()).withColumn("lw", F.col("pe")).withColumn("stop", F.lit(1.0)), "nodes")
    levels = [level]
    half = math.log(0.5)
    for _ in range(depth):
        # the oldest byte of the context goes: contexts are kept newest byte lowest, above the bits of the choice
        up = level.withColumn("up", _shorter(len(levels), depth)).groupBy(F.col("up").alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("lc"))
        up = up.withColumn("pe", _log_kt())
        up = up.withColumn("lw", half + F.greatest("pe", "lc") + F.log1p(F.exp(-F.abs(F.col("pe") - F.col("lc")))))
        level = stage(up.withColumn("stop", F.exp(half + F.col("pe") - F.col("lw"))).drop("lc"), "nodes")
        levels.append(level)
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    mixed = levels[-1].select("node", (F.col("stop") * one).alias("p"), (1 - F.col("stop")).alias("rest"))
    for d in range(1, depth + 1):
        deeper = levels[depth - d].withColumn("up", _shorter(depth + 1 - d, depth))
        above = mixed.select(F.col("node").alias("up"), F.col("p").alias("p0"), F.col("rest").alias("r0"))
        mixed = deeper.join(above, "up").select("node", (F.col("p0") + F.col("r0") * F.col("stop") * one).alias("p"), (F.col("r0") * (1 - F.col("stop"))).alias("rest"))
        if d < depth:
            mixed = stage(mixed, "mixed")
            levels.append(mixed)
    chosen = bits.join(mixed.select("node", "p"), "node")
    out = stage(chosen.groupBy("key").agg(F.sum(F.log10(F.expr("if(bit = 1, p, 1 - p)"))).alias("lp")), "probability")
    unstage(*levels)
    return out


def _shorter(done: int, depth: int) -> Column:
    """node without the oldest byte of its context, of which done - 1 are gone already."""
    left = depth - done  # bytes of context that stay
    return F.col("node").bitwiseAND(F.lit((1 << (8 * (left + 1))) - 1))


class Table:
    """Values of int64 keys by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
        used = np.zeros(1 << bits, bool)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = ~used[slot]
            s, first = np.unique(slot[free], return_index=True)
            put = todo[free][first]
            self.keys[s], self.values[s], used[s] = keys[put], values[put], True
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[first]] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask
        self.used = used

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """0 for a key that is not there."""
        slot = self._slot(keys)
        same = self.keys[slot] == keys
        out = np.where(same & self.used[slot], self.values[slot], 0.0)
        todo = np.flatnonzero(~same & self.used[slot])
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            same = self.keys[slot] == keys[todo]
            hit = same & self.used[slot]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~same & self.used[slot]
            todo, slot = todo[on], slot[on]
        return out


def _scorer(depth: int, n_train: int, n_kinds: int):
    base = math.log10(n_train + n_kinds + 1)

    def run(batches):
        block, held, tables = None, None, None
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]))))
            for lo, hi in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if blocks[lo] != block:
                    block, held, tables = blocks[lo], ([], []), None
                if kinds[lo] < 2:
                    held[kinds[lo]].append((b.column(2).slice(lo, hi - lo).to_numpy(), b.column(3).slice(lo, hi - lo).to_numpy()))
                    continue
                if tables is None:
                    tables = [Table(*(np.concatenate([p[i] for p in h]) if h else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.float64)))) for h in held]
                    held = None
                for r in range(lo, hi):
                    ids, out, texts = unpacked(b.column(4)[r].as_py())
                    code, sizes = byte_grams(texts, depth)
                    lp = tables[0].get(code.view(np.int64))
                    score = np.add.reduceat(lp, np.cumsum(sizes) - sizes)
                    w, at = words(texts)
                    c = tables[1].get(np.concatenate((w.view(np.int64), np.full(len(texts), END_TOKEN, np.int64))))
                    at = np.concatenate((at, np.arange(len(texts))))
                    n = np.bincount(at, minlength=len(texts))
                    known = np.bincount(at[c > 0], minlength=len(texts))
                    flat = np.bincount(at, weights=np.log10(c + 1), minlength=len(texts)) - n * base
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(out), pa.array(n), pa.array(known), pa.array(np.full(len(texts), n_train, np.int64)), pa.array(flat), pa.array(score), pa.array(-score * math.log2(10) / sizes)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                    )

    return run


def score(docs: DataFrame, folds: int = 7, held: int = 2, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    score is the log10 probability of the text and its end; bits_per_byte the code length it gives to each of those bytes.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"))
    blobs = stage(src.mapInArrow(_packer, "block long, blob binary"), "blocks")
    asked = stage(blobs.mapInArrow(_asker(depth), "block long, kind int, key long, n long"), "asked")
    grams = asked.where("kind = 0").drop("kind")
    tokens = asked.where("kind = 1").drop("kind")
    whole = stage(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    probability = model(whole, depth)
    unstage(whole)
    # a token's rows are one for each block that has it, so its count is joined to them: a join splits a frequent token, a window would not
    totals = stage(tokens.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0"), "totals")
    n_train, n_kinds = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    counted = tokens.select("block", "key").join(totals, "key")
    none = F.lit(None).cast("binary").alias("blob")
    rows = (
        grams.join(probability, "key").select("block", F.lit(0).alias("kind"), "key", F.col("lp").alias("value"), none)
        .unionByName(counted.select("block", F.lit(1).alias("kind"), "key", F.col("c").cast("double").alias("value"), none))
        .unionByName(blobs.select("block", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "blob"))
    )
    # a task streams one block after the other; blocks follow the input, so tasks do
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blobs.select("block").distinct().count() // PER_TASK))
    streams = rows.repartition(tasks, F.col("block")).sortWithinPartitions("block", "kind")
    return streams.mapInArrow(_scorer(depth, n_train, n_kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
