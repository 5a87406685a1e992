"""Command line: inspect, extract-text, pack and bench over a corpus.

    python -m quire inspect PATH
    python -m quire extract-text PATH [--page N]
    python -m quire pack IN OUT_DIR
    python -m quire bench DIR [--cold]
    python -m quire probe PATH
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from .operators import sink, tables
from .plans import metrics
from .session import local_session
from .sources import datasource
from .sources.files import read_pdfs

VERSION = "0.1.0"


def relative(path: str, root: str):
    """A file's path under root, its name if root is that file: files of one name in different folders stay apart."""
    bare = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    top = (os.path.abspath(root) if "://" not in root else root.split("://", 1)[1].partition("/")[2]).strip("/") + "/"
    inside = F.ltrim(bare, F.lit("/"))
    return F.when(inside.startswith(top), F.substring(inside, F.lit(len(top) + 1), F.length(inside))).otherwise(F.element_at(F.split(bare, "/"), -1))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("inspect").add_argument("path")
    text = sub.add_parser("extract-text")
    text.add_argument("path")
    text.add_argument("--page", type=int)
    pack = sub.add_parser("pack")
    pack.add_argument("path")
    pack.add_argument("out")
    bench = sub.add_parser("bench")
    bench.add_argument("path")
    bench.add_argument("--cold", action="store_true", help="drop the files from this machine's page cache first")
    sub.add_parser("probe", help="memory that opening each file and reading its first ten objects takes").add_argument("path")
    a = p.parse_args(argv)
    if a.verb == "extract-text" and a.page is not None and a.page < 1:
        print("pages are numbered from 1", file=sys.stderr)
        return 2
    spark = local_session()
    files = read_pdfs(spark, a.path)
    if a.verb == "inspect":
        root = tables.trailer(files).where("key = 'Root'").select("doc_id", F.try_variant_get("value", "$.id", "bigint").alias("root"))
        n = tables.pages(files).groupBy("doc_id").agg(F.count("*").alias("pages"))
        files.select("doc_id", "path").join(tables.load(files), "doc_id").join(n, "doc_id", "left").join(root, "doc_id", "left").drop("doc_id").show(1000, False, vertical=True)
    elif a.verb == "extract-text":
        out = files.select("doc_id", "path").join(tables.page_text(files, {a.page} if a.page else None), "doc_id").orderBy("path", "page_no")
        for row in out.select("text", "error").toLocalIterator():
            print((row.text or "").rstrip("\n"))
            if row.error:
                print(f"error: {row.error.kind}: {row.error.message}", file=sys.stderr)
    elif a.verb == "pack":
        datasource.register(spark)
        done = sink.packed(files).cache()
        named = done.join(files.select("doc_id", "path"), "doc_id").where("content is not null")
        named.select(relative("path", a.path).alias("name"), "content").write.format("quire").mode("append").save(os.path.abspath(a.out))
        sink.report(done).show(1000, False)
    elif a.verb == "probe":
        files.select("doc_id", "path", "length").join(metrics.memory_probe(files), "doc_id").drop("doc_id").show(1000, False)
    else:
        if a.cold:
            print(f"{datasource.evict(a.path)} files dropped from the page cache")
        m = metrics.measured(files).cache()
        metrics.summary(m).show(vertical=True)
        metrics.tool_percentiles(m).show()
        metrics.error_histogram(m).show(1000, False)
        metrics.largest(m).show(1, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
