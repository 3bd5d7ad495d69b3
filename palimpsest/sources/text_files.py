"""Folders of text files as a data source: spark.read.format("text_files") and df.write.format("text_files").

The folder has to be one that the driver and all executors share. Reading deals files out by their sizes;
writing is in two phases: tasks write into a folder of their own, and only when all have ended well are the
files moved to their places, each in one step. A task that dies, or is tried twice, leaves no file behind.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "name string, text string"
PART_BYTES = 16 << 20
PENDING = ".pending-"


class TextFiles(DataSource):
    """Options: path; pattern, an ending that names must have; part_bytes, about how much a task reads."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", ""), int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)


@dataclass
class Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, part_bytes: int) -> None:
        self.path, self.pattern, self.part_bytes = path, pattern, part_bytes

    def partitions(self) -> list[Files]:
        """Files in order of name, as many a partition as have part_bytes; a larger file is one by itself."""
        found = []
        for folder, inner, names in os.walk(self.path):
            inner[:] = sorted(d for d in inner if not d.startswith((".", "_")))
            found += [os.path.join(folder, n) for n in sorted(names) if n.endswith(self.pattern) and not n.startswith((".", "_"))]
        parts, held = [Files([])], 0
        for file in found:
            size = os.path.getsize(file)
            if parts[-1].names and held + size > self.part_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].names.append(os.path.relpath(file, self.path))
            held += size
        return parts

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        for name in partition.names:
            with open(os.path.join(self.path, name), encoding="utf-8", errors="replace", newline="") as file:
                yield name, file.read()


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        if not {"name", "text"} <= set(columns):
            raise ValueError("text_files are written from columns name and text")
        self.path, self.overwrite = path, overwrite
        self.pending = os.path.join(path, PENDING + uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Written:
        """A null text makes an empty file; a name twice in a task, or one outside the folder, is an error."""
        task = TaskContext.get()
        folder, names = os.path.join(self.pending, f"{task.partitionId()}-{task.taskAttemptId()}"), []
        for row in iterator:
            place = os.path.normpath(row.name)
            if os.path.isabs(place) or place.split(os.sep)[0] in ("..", ".", ""):
                raise ValueError(f"not a name within the folder: {row.name!r}")
            target = os.path.join(folder, place)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "x", encoding="utf-8", newline="") as file:
                file.write(row.text or "")
            names.append(place)
        return Written(folder if names else None, names)

    def commit(self, messages: list[Written | None]) -> None:
        moved = [(m.folder, n) for m in messages if m is not None and m.folder for n in m.names]
        names = [n for _, n in moved]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows of one name")
        if self.overwrite and os.path.isdir(self.path):
            for old in os.listdir(self.path):
                place = os.path.join(self.path, old)
                if place != self.pending:
                    shutil.rmtree(place) if os.path.isdir(place) else os.remove(place)
        for folder, name in moved:
            target = os.path.join(self.path, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(os.path.join(folder, name), target)
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TextFiles)
