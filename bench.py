"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quire.operators import sink, tables  # noqa: E402
from quire.plans import metrics  # noqa: E402
from quire.session import local_session  # noqa: E402
from quire.sources import datasource, synthetic  # noqa: E402
from quire.sources.files import read_pdfs  # noqa: E402


def cold(spark, corpus) -> dict:
    """Loads from files that are in no cache: the corpus as PDF files of this machine, dropped from its page cache."""
    with tempfile.TemporaryDirectory(prefix="quire-bench-") as folder:
        datasource.register(spark)
        corpus.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "content").write.format("quire").mode("append").save(folder)
        files = datasource.evict(folder)
        t = time.perf_counter()
        m = metrics.measured(read_pdfs(spark, folder)).cache()
        total = m.agg(F.sum("bytes")).first()[0] / 2**20
        took = time.perf_counter() - t
        p = metrics.tool_percentiles(m).first()
        return {"seconds": round(took, 3), "documents_per_s": round(files / took, 1), "mb_per_s": round(total / took, 2), "load_ms": {"p50": round(p.p50, 3), "p99": round(p.p99, 3)}}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "8g")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4 * int(cpus))
    corpora = {k: synthetic.documents(docs, **o).cache() for k, o in {"plain": {"per_page": 40}, "flate": {"filters": "Fl", "per_page": 40}, "packed": {"layout": "packed12", "per_page": 40}}.items()}
    n = {k: c.count() for k, c in corpora.items()}
    mb = {k: c.agg(F.sum(F.length("content"))).first()[0] / 2**20 for k, c in corpora.items()}
    queries = {
        "load": ("plain", lambda f: tables.load(f)),
        "load_packed": ("packed", lambda f: tables.load(f)),
        "text": ("flate", lambda f: tables.page_text(f)),
        "text_packed": ("packed", lambda f: tables.page_text(f)),
        "spans": ("flate", lambda f: tables.spans(f)),
        "operations": ("flate", lambda f: tables.operations(f)),
        "pack": ("flate", lambda f: sink.report(sink.packed(f))),
        "metrics": ("plain", lambda f: metrics.summary(metrics.measured(f))),
    }
    took, rates = {}, {}
    for name, (kind, q) in queries.items():
        best = 1e9
        for _ in range(2):
            t = time.perf_counter()
            q(corpora[kind]).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        took[name] = round(best, 3)
        rates[name] = {"documents_per_s": round(n[kind] / best, 1), "mb_per_s": round(mb[kind] / best, 2)}
    kernel = metrics.measured(corpora["plain"])
    p = metrics.tool_percentiles(kernel).first()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "load_ms": {"p50": round(p.p50, 3), "p99": round(p.p99, 3)}, "cold": cold(spark, corpora["plain"]), "sf": sf}))


if __name__ == "__main__":
    main()
