"""Corpus metrics over measurements(doc_id, bytes, ms, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ranged

MIB = 1048576.0


def summary(m: DataFrame) -> DataFrame:
    """Counts, shares, totals and rates in one partial aggregation."""
    n, ok = F.count("*"), F.count_if(F.col("error").isNull())
    seconds = F.sum("ms") / 1000.0
    return m.agg(
        n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"), F.coalesce(100.0 * ok / F.nullif(n, F.lit(0)), F.lit(100.0)).alias("pass_percent"),
        F.coalesce(100.0 * (n - ok) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("fail_percent"), F.sum("bytes").alias("bytes"),
        (F.sum("bytes") / MIB / F.nullif(seconds, F.lit(0.0))).alias("mb_per_s"), (n / F.nullif(seconds, F.lit(0.0))).alias("files_per_s"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("avg_ms"),
    )


def at_ranks(m: DataFrame, ranks: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Values at 0-based ranks of ms, each an expression of n. Values are counted by value and range-partitioned; a partition
    adds up its own counts, and those of the partitions before it are one row each. No task holds all values."""
    group = group or []
    by_value = ranged(m.groupBy(*group, "ms").agg(F.count("*").alias("c")), *group, "ms")
    parts = by_value.groupBy(*group, "part").agg(F.sum("c").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.select(*group, "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("held").over(Window.partitionBy(*group)).alias("n"))
    w = Window.partitionBy(*group, "part").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    at = by_value.withColumn("within", F.sum("c").over(w)).join(placed, [*group, "part"]).withColumn("upto", F.col("base") + F.col("within"))
    return at.groupBy(*group).agg(*(F.min(F.when(F.col("upto") > rank, F.col("ms"))).alias(name) for name, rank in ranks.items()))


def tool_percentiles(m: DataFrame) -> DataFrame:
    """p50 at floor(50 n / 100), p99 at floor(99 n / 100) or the last."""
    n = F.col("n")
    return at_ranks(m, {"p50": F.floor(n * 50 / 100), "p99": F.least(F.floor(n * 99 / 100), n - 1)})


def runner_percentiles(m: DataFrame) -> DataFrame:
    """p50 at n / 2, p90 at floor(0.9 n), p99 at ceil(0.99 n) - 1."""
    n = F.col("n")
    return at_ranks(m, {"p50": F.floor(n / 2), "p90": F.pmod(F.floor(n * 0.9), n), "p99": F.least(F.greatest(F.ceil(n * 0.99) - 1, F.lit(0)), n - 1)})


def error_histogram(m: DataFrame) -> DataFrame:
    return m.where("error is not null").groupBy("error").agg(F.count("*").alias("n")).orderBy("error")


def top_errors(m: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent, ties by name: a top-k, not a sort."""
    return error_histogram(m).orderBy(F.desc("n"), "error").limit(k)


def largest(m: DataFrame) -> DataFrame:
    """The largest file, the first of several."""
    return m.agg(F.max_by(F.struct("doc_id", "bytes", "ms"), F.struct("bytes", -F.col("doc_id"))).alias("x")).select("x.*")


def compare(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """Two summaries side by side with their ratio, a row for each metric."""
    long = lambda df, name: df.select(F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", name))
    return long(a, "first").join(long(b, "second"), "metric").withColumn("ratio", F.col("first") / F.nullif(F.col("second"), F.lit(0.0)))


def measured(files: DataFrame) -> DataFrame:
    """measurements of files: each load timed where it runs, with the worker's peak memory."""
    import resource
    import time

    from ..kernel.base import PdfError
    from ..kernel.document import Document
    from ..operators.batches import map_documents, with_password

    def rows(doc_id, content, password):
        start, error = time.perf_counter(), None
        try:
            Document.load(content, password or b"").object_count()
        except PdfError as e:
            error = e.kind
        yield doc_id, len(content), 1000 * (time.perf_counter() - start), error, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    return map_documents(with_password(files), rows, "doc_id bigint, bytes bigint, ms double, error string, rss_kb bigint", ["doc_id", "content", "password"], once=False)


def memory_probe(files: DataFrame, most: int = 10) -> DataFrame:
    """What it takes to open a document and to read its first objects: doc_id, objects read, streams among them, ms to open, peak memory of the worker and how much of it this grew."""
    import resource
    import time

    from ..kernel.base import PdfError, Stream
    from ..kernel.document import Document
    from ..operators.batches import map_documents, with_password

    def peak() -> int:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    def rows(doc_id, content, password):
        before, start = peak(), time.perf_counter()
        ms, found = None, []
        try:
            d = Document.load(content or b"", password or b"")
            ms = 1000 * (time.perf_counter() - start)
            for n in range(1, min(most, d.object_count()) + 1):
                try:
                    found.append(d.object(n))
                except PdfError:
                    continue
        except PdfError:
            pass
        found = [x for x in found if x is not None]
        yield doc_id, len(found), sum(isinstance(x, Stream) for x in found), ms, peak(), peak() - before

    return map_documents(with_password(files), rows, "doc_id bigint, objects bigint, streams bigint, ms double, rss_kb bigint, grown_kb bigint", ["doc_id", "content", "password"], once=False)
