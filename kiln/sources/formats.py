"""Arrow files, workbooks and whole texts as Spark data sources: one large file, or many small ones, are read by many tasks.

register(spark) makes the formats kiln_arrow, kiln_sheet and kiln_text known to spark.read.format(). Paths are those that
pyarrow's file systems open (file, hdfs, s3, gs, abfs), since Python workers read them; readers.read() stays the way for
stores that only Spark reaches. To plan, only a footer, or the head of a sheet, is read.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs  # noqa: F401  as pa.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

from kiln.sources.workbook import first_sheet, sheet_rows

#: Record batches, and rows of a sheet, that a task reads; rows of a batch that it hands on.
BATCHES, ROWS, HANDED = 8, 100_000, 10_000
#: Bytes of whole text files that a task reads.
BYTES = 64 << 20


def opened(path: str):
    fs, inner = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def files(path: str, suffix: str) -> list[str]:
    """The file, or a folder's files with the suffix, in order of their names."""
    fs, inner = pa.fs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type != pa.fs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pa.fs.FileSelector(inner, recursive=True))
    head = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))]
    return sorted(head + f.path for f in found if f.type == pa.fs.FileType.File and f.path.endswith(suffix))


@dataclass
class Span(InputPartition):
    """Record batches or rows from start to stop of a file; stop None: all."""

    path: str
    start: int
    stop: int | None


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kiln_arrow"

    def paths(self) -> list[str]:
        return files(self.options["path"], ".arrow")

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with opened(self.paths()[0]) as f:
            return from_arrow_schema(arrow_reader(f).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.paths(), schema, int(self.options.get("batches", BATCHES)))


def arrow_reader(f):
    """A reader of a file with a footer, or of a stream, whose batches come one after another."""
    begins = f.read(6)
    f.seek(0)
    return pa.ipc.open_file(f) if begins == b"ARROW1" else pa.ipc.open_stream(f)


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, each: int):
        self.paths, self.each = paths, each
        self.kinds = schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with opened(path) as f:
                n = getattr(arrow_reader(f), "num_record_batches", None)
            starts = range(0, n, self.each) if n is not None else []
            out += [Span(path, i, min(n, i + self.each)) for i in starts] if n is not None else [Span(path, 0, None)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not span.path:
            return
        wanted = to_arrow_schema(self.kinds)
        with opened(span.path) as f:
            source = arrow_reader(f)
            batches = source if span.stop is None else (source.get_batch(i) for i in range(span.start, span.stop))
            for batch in batches:
                yield from pa.Table.from_batches([batch]).select(wanted.names).cast(wanted).to_batches(HANDED)


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kiln_sheet"

    def paths(self) -> list[str]:
        return files(self.options["path"], ".xlsx")

    def schema(self) -> StructType:
        with opened(self.paths()[0]) as f:
            head = next(sheet_rows(f, 0, 1), [])
        out = StructType()
        for name in head:
            out.add(name, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.paths(), schema, int(self.options.get("rows", ROWS)))


class SheetReader(DataSourceReader):
    """Rows below the first one. A task streams through the sheet to its rows and holds a batch of them."""

    def __init__(self, paths: list[str], schema: StructType, each: int):
        self.paths, self.width, self.names, self.each = paths, len(schema), schema.names, each

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with opened(path) as f, zipfile.ZipFile(f) as book, book.open(first_sheet(book)) as sheet:
                found = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', sheet.read(4096))
            # the last range is open: the stated size only deals the rows out
            starts = list(range(1, int(found[1]) if found else 2, self.each)) or [1]
            out += [Span(path, i, j) for i, j in zip(starts, [*starts[1:], None])]
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        rows: list[list[str]] = []
        with opened(span.path) as f:
            for row in sheet_rows(f, span.start, span.stop):
                rows.append((row + [""] * self.width)[: self.width])
                if len(rows) == HANDED:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=self.names)


@dataclass
class Group(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class TextSource(DataSource):
    """(value, path) of whole text files, as many small ones a task as BYTES holds."""

    @classmethod
    def name(cls) -> str:
        return "kiln_text"

    def schema(self) -> str:
        return "value string, path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        path, suffix = self.options["path"], self.options.get("suffix", ".md")
        return TextReader(files(path, suffix), int(self.options.get("bytes", BYTES)))


class TextReader(DataSourceReader):
    def __init__(self, paths: list[str], each: int):
        self.paths, self.each = paths, each

    def partitions(self) -> list[InputPartition]:
        groups, room = [Group([])], self.each
        for path in self.paths:
            fs, inner = pa.fs.FileSystem.from_uri(path)
            size = fs.get_file_info(inner).size or 0
            if groups[-1].paths and size > room:
                groups.append(Group([]))
                room = self.each
            groups[-1].paths.append(path)
            room -= size
        return groups

    def read(self, group: Group) -> Iterator[tuple[str, str]]:
        for path in group.paths:
            with opened(path) as f:
                yield f.read().decode(errors="replace"), path


def register(spark: SparkSession) -> None:
    for source in (ArrowSource, SheetSource, TextSource):
        spark.dataSource.register(source)
