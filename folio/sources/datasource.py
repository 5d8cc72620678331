"""``spark.read.format("folio")``: relations as a data source with pushed filters.

Options: ``path`` (a folder that all executors mount), ``relation`` (``errors``
has the files that can't be read), ``password`` and ``partition_bytes``: small
files share a task. Equality and IN filters on ``doc_id`` leave out files, so a query
for some documents opens only those.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from folio.core.extract import RELATIONS
from folio.core.objects import Document, PdfError


ERRORS = "code string, offset long, message string"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("doc_id",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("doc_id",):
                found = set(f.value)
            else:
                yield f
                continue
            self.wanted = found if self.wanted is None else self.wanted & found

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.options["path"], "**", "*.pdf"), recursive=True))
        most, groups, held = int(self.options.get("partition_bytes", 64 << 20)), [[]], 0
        for f in files:
            if self.wanted is None or f in self.wanted:
                size = os.path.getsize(f) + (1 << 16)  # opening a file costs something too
                if groups[-1] and held + size > most:
                    groups.append([])
                    held = 0
                groups[-1].append(f)
                held += size
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from ((path, *row) for row in self._rows(path))

    def _rows(self, path: str) -> list[tuple]:
        relation = self.options.get("relation", "docs")
        try:
            with open(path, "rb") as f:
                doc = Document(f.read(), self.options.get("password", "").encode())
            if relation == "errors":
                doc.pages()
                return []
            return list(RELATIONS[relation][0](doc))
        except Exception as e:
            if self.options.get("mode", "permissive") == "strict":
                raise
            if relation != "errors":
                return []
            return [(e.code, e.offset, e.message) if isinstance(e, PdfError) else (type(e).__name__, -1, str(e))]


class FolioDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        relation = self.options.get("relation", "docs")
        return "doc_id string, " + (ERRORS if relation == "errors" else RELATIONS[relation][1])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and turns on pushed filters, which the reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolioDataSource)
