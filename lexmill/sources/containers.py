"""Office containers as a data source: ``spark.read.format("lexmill").option("kind", "cells").load(folder)``.

A kind is a reader: the extensions that it takes, a function from a file's path and bytes to rows, and the rows' columns.  A plug-in
is a subclass of ``Containers`` with readers and a name of its own, registered like it (``spark.dataSource.register``).

Files are dealt to partitions by bytes, ``partition_bytes`` at most if a file isn't larger; each is opened where its partition runs.  Given a
schema, a read makes the columns of that schema only.  Folders are named by path or by a URI of Arrow's file systems.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexmill.sources import ooxml
from lexmill.sources.sinks import file_system


@dataclass(frozen=True)
class Reader:
    """What a kind of containers gives: the rows of (path, content) in columns of ``schema``, of files with these extensions."""

    extensions: tuple[str, ...]
    rows: Callable[[str, bytes], Iterator[dict]]
    schema: str
    #: The column that is -1 in the one row for the whole file.
    mark: str


@dataclass
class Files(InputPartition):
    """The files of a partition."""

    paths: tuple[str, ...]


def dealt(sizes: Mapping[str, int], most: int) -> list[tuple[str, ...]]:
    """Files into groups of ``most`` bytes: the largest first, each into the first group with room among the last few begun."""
    groups: list[list[str]] = []
    room: list[int] = []
    for path, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = next((k for k in range(max(0, len(groups) - 16), len(groups)) if room[k] >= size), None)
        if at is None:
            at = len(groups)
            groups.append([])
            room.append(most)
        groups[at].append(path)
        room[at] -= size
    return [tuple(g) for g in groups]


class ContainerReader(DataSourceReader):
    def __init__(self, reader: Reader, options: Mapping[str, str], schema: StructType):
        self.reader, self.schema = reader, schema
        self.folder, self.most = options["path"], int(options.get("partition_bytes", 64 << 20))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = file_system(self.folder)
        at = store.get_file_info(root)
        found = [at] if at.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part.startswith(".") for part in p[len(root) :].split("/"))
        sizes = {f.path: f.size for f in found if f.is_file and f.path.lower().endswith(self.reader.extensions) and (at.is_file or not hidden(f.path))}
        return [Files(g) for g in dealt(sizes, self.most)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.folder)
        wanted = to_arrow_schema(self.schema)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                rows = ooxml.file_rows(path, f.read(), self.reader.rows, self.reader.mark)
            rows = [{c: r.get(c) for c in wanted.names} for r in rows]
            for at in range(0, len(rows), ooxml.ROWS):
                yield pa.RecordBatch.from_pylist(rows[at : at + ooxml.ROWS], schema=wanted)


class Containers(DataSource):
    """Paragraphs of Word files, cells of workbooks, paragraphs of slides, by the option ``kind``."""

    readers: Mapping[str, Reader] = {
        "paragraphs": Reader((".docx",), ooxml.word_rows, ooxml.WORD_SCHEMA, "elem_no"),
        "cells": Reader((".xlsx",), ooxml.sheet_rows, ooxml.CELL_SCHEMA, "sheet_no"),
        "slides": Reader((".pptx",), ooxml.slide_rows, ooxml.SLIDE_SCHEMA, "slide_no"),
    }

    @classmethod
    def name(cls) -> str:
        return "lexmill"

    def _reader(self) -> Reader:
        kind = self.options.get("kind", next(iter(self.readers)))
        if kind not in self.readers:
            raise ValueError(f"kind is one of {', '.join(self.readers)}")
        return self.readers[kind]

    def schema(self) -> str:
        return self._reader().schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContainerReader(self._reader(), self.options, schema)


def register(spark: SparkSession, source: type[DataSource] = Containers) -> None:
    spark.dataSource.register(source)
