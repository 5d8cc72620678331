"""Reading PDF files into relations and writing documents from rows.

Files are rows (doc_id, content). Each relation is one narrow Arrow stage over
those rows: nothing is shuffled, and only what the relation needs is parsed. Files
that are built, changed and read are built, changed and read in one such stage, so a
task has one Python process, and a file's bytes stay in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.core import writer
from folio.core.extract import LAZY, RELATIONS
from folio.core.objects import Document, PdfError

Row = tuple
TOO_LARGE = "FileTooLarge"


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", max_bytes: int = 1 << 30) -> DataFrame:
    """(doc_id, content, _error) of the files below a path; those over ``max_bytes`` stay unread: null with an error code."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    read = files.where(F.col("length") <= max_bytes).select(F.col("path").alias("doc_id"), "content", F.lit(None).cast("string").alias("_error"))
    unread = files.where(F.col("length") > max_bytes).select(F.col("path").alias("doc_id"), F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("_error"))
    return read.unionByName(unread)


def _types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return arrow.names, arrow.types


#: Rows taken out of an Arrow batch at once, and about the size of what a batch holds when it is handed on.
TAKEN, HELD_BYTES = 64, 4 << 20
_SIZED = frozenset((str, bytes, list))


def _size(structs: list[dict]) -> int:
    return sum([16 + len(x) if type(x) in _SIZED else 16 for s in structs for x in s.values()])


def _rows_of(batches: Iterator[pa.RecordBatch], each: Callable[..., Iterator[Row]], names: list[str], types: list[pa.DataType], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)

    for b in batches:
        for at in range(0, b.num_rows, TAKEN):
            for values in zip(*(c.to_pylist() for c in b.slice(at, TAKEN).columns)):
                first = values[0]
                for row in each(*values):
                    held.append((first, *row))
                    for x in row:
                        if type(x) in _SIZED:
                            size += len(x) if type(x) is not list else _size(x) if x and type(x[0]) is dict else 16 * len(x)
                    if size >= HELD_BYTES or len(held) >= rows:
                        yield batch()
                        held.clear()
                        size = 0
    if held:
        yield batch()


def flat_map(df: DataFrame, columns: list[str], schema: str, each: Callable[..., Iterator[Row]], rows: int = 4096) -> DataFrame:
    """Rows that ``each(*values)`` gives for every row; the first column stays in front.

    An Arrow batch has ``rows`` of them, or fewer if they are large: characters, bytes and 16 for
    an element of a list or a field of a struct are counted.
    """
    first, kinds = columns[0], dict(df.dtypes)
    whole = f"`{first}` {kinds[first]}" + (f", {schema}" if schema else "")
    names, types = _types(whole)

    return df.select(*columns).mapInArrow(lambda batches: _rows_of(batches, each, names, types, rows), whole)


def _picked(name: str, columns: tuple[str, ...]) -> tuple[Callable[..., Iterator[Row]], str, list[int] | None]:
    """Function, schema and places of a relation's columns; all of them if none are named."""
    rows, schema = RELATIONS[name]
    if not columns:
        return rows, schema, None
    fields = [x.strip() for x in schema.split(", ")]
    pick = [next(i for i, f in enumerate(fields) if f.split()[0] == c) for c in columns]
    if name in LAZY:
        lazy = rows
        rows = lambda doc: lazy(doc, columns)
    return rows, ", ".join(fields[i] for i in pick), pick


def _found(rows: Callable[..., Iterator[Row]], pick: list[int] | None, doc: Document) -> list[Row]:
    return list(rows(doc)) if pick is None else [tuple([r[i] for i in pick]) for r in rows(doc)]


class Pdf:
    """Relations of the files in ``files`` (doc_id, content, and _error if there is one).

    A file that can't be read gives no rows, and one row in ``errors()``; with
    ``strict`` the job fails. The password may be a text or the name of a column.
    """

    def __init__(self, files: DataFrame, password: str = "", password_column: str | None = None, strict: bool = False):
        secret = F.col(password_column) if password_column else F.lit(password)
        error = F.col("_error") if "_error" in files.columns else F.lit(None).cast("string")
        self.files = files.select("doc_id", "content", secret.alias("_password"), error.alias("_error"))
        self.strict = strict
        # how the files are built, if that is known and needs no other column
        self._made = None if password_column else _recipe(files)
        self._password = password

    def relation(self, name: str, *columns: str) -> DataFrame:
        """A relation's rows; with ``columns`` only doc_id and these, and others aren't computed or handed on."""
        rows, schema, pick = _picked(name, columns)
        strict = self.strict

        def each(doc_id: Any, content: bytes | None, password: str | None) -> Iterator[Row]:
            try:
                # whole relation first: a file that fails midway gives no rows
                yield from _found(rows, pick, Document(content or b"", (password or "").encode()))
            except Exception:
                if strict:
                    raise

        return self._flat_map(schema, each)

    def together(self, **wanted: list[str]) -> DataFrame:
        """(doc_id, and for each relation an array of structs of the columns wanted): a file is built and parsed once for all.

        A relation that fails is null; a file that can't be opened gives no row.
        """
        parts = [(*_picked(name, tuple(columns)), columns) for name, columns in wanted.items()]
        schema = ", ".join(f"{name} array<struct<{', '.join(f'{f.split()[0]}: {f.split()[1]}' for f in part[1].split(', '))}>>" for name, part in zip(wanted, parts))
        strict = self.strict

        def each(doc_id: Any, content: bytes | None, password: str | None) -> Iterator[Row]:
            try:
                doc = Document(content or b"", (password or "").encode())
            except Exception:
                if strict:
                    raise
                return
            out = []
            for rows, _, pick, columns in parts:
                try:
                    out.append([dict(zip(columns, r)) for r in _found(rows, pick, doc)])
                except Exception:
                    if strict:
                        raise
                    out.append(None)
            yield tuple(out)

        return self._flat_map(schema, each)

    def _flat_map(self, schema: str, each: Callable[..., Iterator[Row]]) -> DataFrame:
        """Rows of ``each(doc_id, content, password)``, in the stage that builds the files if that is known."""
        if self._made:
            source, names, make = self._made
            password = self._password
            return flat_map(source, names, schema, lambda *values: each(values[0], make(*values), password))
        return flat_map(self.files, ["doc_id", "content", "_password"], schema, each)

    def errors(self) -> DataFrame:
        """(doc_id, code, offset, message) of files that can't be read."""

        def each(doc_id: Any, content: bytes | None, password: str | None, error: str | None) -> Iterator[Row]:
            if error:
                yield error, -1, "not read"
                return
            try:
                doc = Document(content or b"", (password or "").encode())
                doc.page_count()
                doc.pages()
            except PdfError as e:
                yield e.code, e.offset, e.message
            except Exception as e:
                yield type(e).__name__, -1, str(e)

        return flat_map(self.files, ["doc_id", "content", "_password", "_error"], "code string, offset long, message string", each)

    def __getattr__(self, name: str):
        if name in RELATIONS:
            return lambda *columns: self.relation(name, *columns)
        raise AttributeError(name)


def _recipe(files: DataFrame) -> tuple[DataFrame, list[str], Callable[..., bytes]] | None:
    """Rows, columns and function that a result of ``build`` comes from."""
    return files.__dict__.get("_folio_recipe")


def build(df: DataFrame, columns: list[str], make: Callable[..., bytes], batch: int = 64) -> DataFrame:
    """(first column, content): the file that ``make(*values)`` builds of each row.

    Files that are built of built ones are made in the same stage.
    """
    made = _recipe(df)
    if made and list(columns) == [made[1][0], "content"]:
        df, columns, before = made
        after = make
        make = lambda *values: after(values[0], before(*values))
    out = flat_map(df, columns, "content binary", lambda *values: iter([(make(*values),)]), batch)
    out._folio_recipe = df, list(columns), make
    return out


def text_files(docs: DataFrame, id_column: str = "doc_id", text: str = "text", info: dict[str, str] | None = None, **options: Any) -> DataFrame:
    """(doc_id, content): each row's text as a document; ``info`` names columns for title, subject and so on."""
    info = info or {}
    keys = list(info)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("_text"), *[F.col(info[k]).cast("string").alias(f"_{k}") for k in keys])
    return build(source, source.columns, lambda _, body, *values: writer.text_pdf(body, dict(zip(keys, values)), **options))


def save(files: DataFrame, path: str) -> None:
    """Writes each (doc_id, content) row as ``path/doc_id.pdf`` from the executors.

    ``path`` is a folder that all of them mount. Files of the same name are
    replaced. For object stores write ``files`` as Parquet instead: one file a
    row is many small objects.
    """
    import os

    os.makedirs(path, exist_ok=True)

    def put(doc_id: Any, content: bytes) -> Iterator[Row]:
        at = os.path.join(path, f"{str(doc_id).replace(os.sep, '_')}.pdf")
        with open(f"{at}.part", "wb") as f:
            f.write(content)
        os.replace(f"{at}.part", at)
        yield (len(content),)

    flat_map(files, ["doc_id", "content"], "n_bytes long", put).agg(F.sum("n_bytes")).collect()
