"""A Python data source, `quire`: spark.read.format("quire").load(directory) gives (path, page_no, text, error).

An equality filter on page_no is pushed into the reader, so other pages are not parsed. It reads and writes folders that
every machine sees under the same path; for object stores use read_pdfs, which goes through Spark's own file readers.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..kernel.base import PdfError
from ..kernel.document import Document
from ..operators.tables import UNEXPECTED, fault


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def pdf_paths(root: str) -> list[str]:
    root = root.removeprefix("file://")
    found = glob.glob(f"{root}/**/*", recursive=True) if os.path.isdir(root) else [root]
    return sorted(p for p in found if p.lower().endswith(".pdf"))


def evict(root: str) -> int:
    """Drop the PDFs of a local folder from the page cache, so that what is read next is cold; how many there were."""
    paths = pdf_paths(root)
    for path in paths:
        f = os.open(path, os.O_RDONLY)
        try:
            os.fsync(f)
            os.posix_fadvise(f, 0, 0, os.POSIX_FADV_DONTNEED)
        finally:
            os.close(f)
    return len(paths)


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.per, self.page = options["path"], int(options.get("files_per_partition", 64)), None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page_no",) and type(f.value) is int and self.page is None:
                self.page = f.value
            else:
                yield f

    def partitions(self):
        paths = pdf_paths(self.root)
        return [Files(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [Files([])]

    def read(self, partition):
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    d = Document.load(f.read())
                for i, n in enumerate(d.page_ids()):
                    if self.page is None or self.page == i + 1:
                        yield path, i + 1, d.page_text(n), None
            except (PdfError, *UNEXPECTED) as e:
                yield path, self.page, None, fault(e)[0]


class FilesWriter(DataSourceWriter):
    """Rows (name, content) as files of a folder, names with its subfolders; files of a failed job are removed."""

    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")

    def write(self, iterator):
        done = []
        for row in iterator:
            name = os.path.normpath(row.name)
            if os.path.isabs(name) or name.split(os.sep)[0] == "..":
                raise ValueError(f"{row.name} lies outside the folder")
            path = os.path.join(self.root, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "wb") as f:
                f.write(row.content)
            os.replace(path + ".part", path)
            done.append(path)
        return Written(done)

    def abort(self, messages):
        for m in messages:
            for p in m.paths if m else ():
                if os.path.exists(p):
                    os.remove(p)


class PdfSource(DataSource):
    @classmethod
    def name(cls):
        return "quire"

    def schema(self):
        return "path string, page_no int, text string, error string"

    def reader(self, schema):
        return PagesReader(self.options)

    def writer(self, schema, overwrite):
        return FilesWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
