"""A data source of scan files that plans ranges of their bytes, so that no file is one row in memory or one task.

    spark.dataSource.register(ScanSource)
    spark.read.format("scans").option("columns", 5).load("hdfs://host/scans")

Stores are those that ``pyarrow.fs`` opens (local folders, HDFS, S3, GCS); for any other that Spark reaches there is read_points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import POINTS, point_batch

#: Bytes of a task, and of what it holds at once.
SPLIT = 64 << 20
READ = 4 << 20


@dataclass
class Ranges(InputPartition):
    """Path, first byte and number of bytes of each piece of a task."""

    pieces: list[tuple[str, int, int]]


class ScanSource(DataSource):
    """``path, point_idx, x, y, z, intensity, ring``, as read_points gives them, of a file or of all files below a folder.

    Options: ``columns``, numbers of a record (4 or 5); ``split``, bytes of a task (SPLIT). Small files share a task, large
    ones are cut between records. A file whose size is no multiple of a record is an error; an empty one has no points.
    """

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema: object) -> ScanReader:
        return ScanReader(self.options["path"], int(self.options.get("columns", 5)), int(self.options.get("split", SPLIT)))


class ScanReader(DataSourceReader):
    def __init__(self, path: str, columns: int, split: int):
        if columns not in (4, 5):
            raise ValueError("scans have 4 or 5 numbers a point")
        self.path, self.columns, self.record = path, columns, 4 * columns
        self.split = max(split // self.record, 1) * self.record

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Ranges]:
        store, root = self._open()
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        out, held, room = [], [], self.split
        for f in sorted(files, key=lambda f: f.path):
            if f.size % self.record:
                raise ValueError(f"{f.path} isn't made of records of {self.columns} numbers")
            for first in range(0, f.size, self.split):
                size = min(self.split, f.size - first)
                if size > room and held:
                    out.append(Ranges(held))
                    held, room = [], self.split
                held.append((f.path, first, size))
                room -= size
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        step = max(READ // self.record, 1) * self.record
        for path, first, size in partition.pieces:
            with store.open_input_file(path) as f:
                for at in range(first, first + size, step):
                    data = f.read_at(min(step, first + size - at), at)
                    yield point_batch(path, pa.py_buffer(data), self.columns, at // self.record)
