"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct word shingles. Its MinHash signature has COORDINATES values, and the document is posted
under each (coordinate, value) pair. Two documents whose sets have Jaccard similarity s share Binomial(COORDINATES, s)
postings; pairs with at least MATCH shared postings are candidates, MATCH the most that loses a pair at the threshold with probability
LOSS at most (35 for a threshold of 0.8), and every candidate is confirmed on the full sets.

Counting skips what cannot reach MATCH. A posting that only one text has is no collision: a text with c shared postings
needs MATCH of those c, so texts with c < MATCH are skipped whole, and by the prefix principle two texts that share MATCH
postings share one among the c - MATCH + 1 rarest of each. Only those are merged.

Merging also skips by two bits of each coordinate, which a posting carries: equal coordinates have equal bits, so a pair with
fewer than MATCH equal bit pairs cannot have MATCH collisions and is never made. This loses nothing.

Groups of near copies are collapsed before pairs are made. Every posting picks ROUNDS of its members as hubs by hashes;
the likely pairs of a text and a hub span clusters. In each of ROUNDS rounds every text is confirmed or not against its
likeliest hub of another component, and components are joined up. Where a cluster still has several components, the
texts outside its largest one, usually few, are compared exactly to the largest one's and to each other in tasks of at
most two chunks of CHUNK texts, which find intersections by an inverted index and hand on spanning links only. What is
likely across clusters is made as pairs and confirmed. So every link between different components is tried, no task holds a
whole group, a key with many texts is dealt in chunks whose pairs are tasks of their own, and a group's pairs are never rows. Exact copies of a set are one class from the start.

Nulls and odd cases: a text that is null, empty or white space has an empty set and links with nothing; a row without id
links with nothing, has a null component_id and is kept; rows that repeat an id and a text get the same answer; ids that
repeat with different texts are judged by each row's own text. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, shingle_sets, slices, stage, unstage

#: A worker looks at STRETCH rows of a batch, or postings of a text, at a time, so that its memory follows neither.
COORDINATES, LOSS, ROUNDS, CHUNK, STRETCH = 64, 2e-6, 2, 256, 256
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def match_of(percent: int) -> int:
    """Most shared postings to ask for, so that a pair at the threshold falls short of them with probability LOSS at most; 1 at least."""
    s, below, m = percent / 100, 0.0, 0
    while m < COORDINATES and (below := below + math.comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)) <= LOSS:
        m += 1
    return max(1, m)


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima of a non-empty set."""
    low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, ((s[i : i + 2048, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32).view(np.int32)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _stretches(batches):
    for b in batches:
        yield from (b.slice(at, STRETCH) for at in range(0, b.num_rows, STRETCH))


def _signer(k: int):
    def sign(batches):
        for batch in _stretches(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                sets = shingle_sets(texts[lo:hi], k)
                sigs = [signature(s) for s in sets if len(s)]
                bits = np.array(sigs, dtype=np.int64).reshape(-1, COORDINATES)
                low, high = (np.zeros(len(sets), np.int64) for _ in range(2))
                some = np.flatnonzero([len(s) > 0 for s in sets])
                low[some], high[some] = ((((bits >> i) & 1) << np.arange(COORDINATES)).sum(axis=1) for i in (0, 1))
                ends = np.cumsum([0, *(COORDINATES if len(s) else 0 for s in sets)]).astype(np.int32)
                d = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in d], pa.int64()),
                        pa.array([x[1] for x in d], pa.int64()),
                        pa.array(low),
                        pa.array(high),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "low", "high", "sig"],
                )

    return sign


def _counter(match: int):
    """Pairs whose signatures agree in match places."""

    def count(batches):
        for b in batches:
            n = b.num_rows
            x, y = (b.column(i).flatten().to_numpy().reshape(n, COORDINATES) for i in (2, 3))
            same = (x == y).sum(axis=1)
            ok = same >= match
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(same[ok].astype(np.int32))], ["a", "b", "same"])

    return count


def _confirmer(k: int, percent: int):
    def confirm(batches):
        seen: dict = {}
        size = 0

        def get(i, text, d):
            nonlocal size
            if (i, d) not in seen:
                if size > 1 << 20:
                    seen.clear()
                    size = 0
                s = shingle_sets([text], k)[0]
                if digest(s)[0] != d:  # another text under the same id; the right one comes too
                    return None
                seen[i, d] = s
                size += len(s)
            return seen[i, d]

        for b in _stretches(batches):
            out = []
            for a, z, da, dz, ta, tz in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                x, y = get(a, ta, da), get(z, tz, dz)
                if x is not None and y is not None:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a, z))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return confirm


def _overlaps(rows: list, cols: list, percent: int):
    """(i, j) of rows[i] and cols[j] that are linked, by an inverted index of cols; a row at a time."""
    size = np.array([len(c) for c in cols])
    keys = np.concatenate(cols)
    order = np.argsort(keys, kind="stable")
    owner = np.repeat(np.arange(len(cols), dtype=np.int32), size)[order]
    keys = keys[order]
    del order
    for i, x in enumerate(rows):
        both = np.zeros(len(cols), np.int64)
        for part in range(0, len(x), STRETCH):  # of postings, each of which is at most as long as cols
            lo, hi = np.searchsorted(keys, x[part : part + STRETCH]), np.searchsorted(keys, x[part : part + STRETCH], side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both += np.bincount(owner[at], minlength=len(cols))
        yield i, np.flatnonzero(100 * both >= percent * (len(x) + size - both))


def _solver(k: int, percent: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        texts = pdf["text"].tolist()
        sets = [s for lo, hi in slices(texts) for s in shingle_sets(texts[lo:hi], k)]
        for i, s in enumerate(sets):
            if len(s) == 0 or digest(s)[0] != pdf["d1"].iat[i]:
                sets[i] = np.zeros(0, np.uint64)  # another text under the same id
        for _, part in pdf.groupby(["cluster", "kind", "i", "j"], sort=True):
            left = part.index[(part["chunk"] == part["i"]) & part["outside"]].tolist()
            right = part.index[(part["chunk"] == part["j"]) & (part["outside"] == (part["kind"] == 0))].tolist()
            left, right = ([x for x in side if len(sets[x])] for side in (left, right))
            if not left or not right:
                continue
            parent: dict = {}

            def find(x, parent=parent):
                while (y := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(y, y)
                return x

            label, rep = pdf["label"], pdf["rep"]
            for x, hits in _overlaps([sets[x] for x in left], [sets[x] for x in right], percent):
                for y in hits.tolist():
                    f, g = find(label.iat[left[x]]), find(label.iat[right[y]])
                    if f != g:
                        parent[max(f, g)] = min(f, g)
                        edges.append((rep.iat[left[x]], rep.iat[right[y]]))
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return solve


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs; see the module for the method and odd cases."""
    match = match_of(percent)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(src.mapInArrow(_signer(shingle_words), "doc_id long, n_shingles long, d1 long, d2 long, low long, high long, sig array<int>"), "signed")
    firsts = [F.first(c).alias(c) for c in ("low", "high", "sig")]
    classes = stage(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *firsts),
        "classes",
    )

    passed: list[DataFrame] = []

    def passing(df: DataFrame, name: str) -> DataFrame:
        passed.append(stage(df, name))
        return passed[-1]

    posted = classes.select("rep", F.posexplode("sig").alias("p", "v")).select("rep", F.expr("shiftleft(cast(p as long), 32) | (cast(v as long) & 4294967295L)").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    posts = posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("posts")).where(F.size("posts") >= match)
    posts = passing(posts.select("rep", F.expr(f"transform(slice(posts, 1, size(posts) - {match - 1}), x -> x.key)").alias("keys")), "posts")
    sigs = passing(classes.drop("d2").join(posts, "rep"), "sigs")
    prefixes = sigs.select("rep", "n", "low", "high", F.explode("keys").alias("key"))

    def renamed(df: DataFrame, **cols: str) -> DataFrame:
        return df.select(*(F.col(old).alias(new) for old, new in cols.items()))

    def counted(pairs: DataFrame) -> DataFrame:
        a = renamed(sigs, rep="a", sig="sa")
        b = renamed(sigs, rep="b", sig="sb")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_counter(match), "a long, b long, same int")

    # likely pairs of a text and a hub of one of its postings; what they connect is a cluster
    agree = "bit_count(~((low ^ low2) | (high ^ high2)))"
    likely = f"least(n, n2) * 100 >= greatest(n, n2) * {percent} and {agree} >= {match}"
    hub = (F.min_by(F.struct("rep", "n", "low", "high"), F.xxhash64("rep", "key", F.lit(r))) for r in range(ROUNDS))
    hubs = prefixes.groupBy("key").agg(F.array_distinct(F.array(*hub)).alias("hs"), F.count("*").alias("c")).where("c > 1").select("key", F.explode("hs").alias("h"))
    hubs = hubs.select("key", F.col("h.rep").alias("b"), *(F.col(f"h.{c}").alias(c + "2") for c in ("n", "low", "high")))
    spokes = prefixes.join(hubs, "key").where(f"rep <> b and {likely}").groupBy(F.col("rep").alias("a"), "b").agg(F.first(F.expr(agree)).alias("same"))
    spokes = passing(spokes, "spokes")
    clusters = passing(components(spokes).select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "clusters")

    # what is likely across clusters
    placed = prefixes.join(clusters, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    spread = placed.groupBy("key").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.ceil(F.count("*") / (2 * CHUNK)).alias("chunks")).where("least < most").select("key", "chunks")
    placed = passing(placed.join(spread, "key").withColumn("chunk", F.expr("pmod(xxhash64(rep, 2), chunks)")), "placed")
    # a key of many texts meets itself chunk by chunk
    here = placed.withColumn("i", F.col("chunk")).withColumn("j", F.explode(F.expr("sequence(chunk, chunks - 1)")))
    other = placed.select("key", F.explode(F.expr("sequence(0L, chunk)")).alias("i"), F.col("chunk").alias("j"), F.col("rep").alias("b"), *(F.col(c).alias(c + "2") for c in ("n", "low", "high", "cluster")))
    across = here.join(other, ["key", "i", "j"]).where(f"(i < j or rep < b) and cluster <> cluster2 and {likely}")
    across = across.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    across = passing(counted(across), "across")

    # only texts that are in a likely pair are moved, and each once
    wanted = passing(clusters.select("rep").unionByName(renamed(across, a="rep")).unionByName(renamed(across, b="rep")).distinct(), "wanted")
    texts = passing(src.join(renamed(wanted, rep="doc_id"), "doc_id"), "texts")
    digests = passing(sigs.join(wanted, "rep").select("rep", "d1"), "digests")

    def confirmed(pairs: DataFrame) -> DataFrame:
        named = pairs.select("a", "b").join(renamed(digests, rep="a", d1="da"), "a").join(renamed(digests, rep="b", d1="db"), "b")
        full = named.join(renamed(texts, doc_id="a", text="ta"), "a").join(renamed(texts, doc_id="b", text="tb"), "b")
        return full.select("a", "b", "da", "db", "ta", "tb").mapInArrow(_confirmer(shingle_words, percent), "a long, b long")

    left, links, groups = spokes, None, None
    for _ in range(ROUNDS):
        best = left.groupBy("a").agg(F.max(F.struct("same", "b")).alias("x")).select("a", "x.b")
        new = passing(confirmed(best), "links")
        links = new if links is None else links.unionByName(new)
        groups = passing(components(links), "groups")
        left = spokes.join(renamed(groups, id="a", component="la"), "a", "left").join(renamed(groups, id="b", component="lb"), "b", "left").where("coalesce(la, a) <> coalesce(lb, b)")

    # clusters with several components: the texts outside the largest one against all
    of = passing(clusters.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "cluster", F.coalesce("component", "rep").alias("label")), "labels")
    shares = of.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    sizes = shares.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("inside"), F.sum("c").alias("total")).where("inside < total")
    sizes = sizes.select("cluster", "main", F.ceil(F.col("inside") / CHUNK).alias("mains"), F.ceil((F.col("total") - F.col("inside")) / CHUNK).alias("outs"))
    dealt = of.join(sizes, "cluster").withColumn("outside", F.col("label") != F.col("main"))
    dealt = dealt.withColumn("chunk", F.expr("pmod(xxhash64(rep), if(outside, outs, mains))"))
    # kind 0: chunks of the outside with each other; kind 1: chunks of the outside with chunks of the largest component
    among = dealt.where("outside").withColumn("o", F.explode(F.expr("sequence(0L, outs - 1)"))).withColumn("kind", F.lit(0)).withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o"))
    against = dealt.withColumn("o", F.explode(F.expr("sequence(0L, if(outside, mains, outs) - 1)"))).withColumn("kind", F.lit(1))
    against = against.withColumn("i", F.expr("if(outside, chunk, o)")).withColumn("j", F.expr("if(outside, o, chunk)"))
    cell = ["cluster", "kind", "i", "j"]
    tasks = among.unionByName(against).select(*cell, "rep", "label", "outside", "chunk", "mains", "outs")
    # clusters of one task are solved some at a time
    per = F.when((F.col("mains") == 1) & (F.col("outs") == 1), F.pmod(F.xxhash64("cluster"), F.lit(max(64, wanted.count() // CHUNK)))).otherwise(F.xxhash64(*cell))
    full = tasks.withColumn("bucket", per).drop("mains", "outs").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").join(digests, "rep")
    new = passing(full.groupBy("bucket").applyInPandas(_solver(shingle_words, percent), "a long, b long"), "links")
    links = links.unionByName(new)

    links = links.unionByName(passing(confirmed(across), "links"))
    groups = components(links)
    unstage(*passed)  # the components have staged what they need of the links
    of_class = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "d1", "d2")
        .join(of_class, ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
