"""Size, digest and line count of staged files: a data source that reads every file in pieces.

A digest needs the bytes of a file in order, so a file is read by one task; it
passes through in pieces of ``piece_bytes`` and is never held, whatever its
size.  Files are dealt to tasks by size, the largest first, so that tasks end
together.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

INSPECTED = (StructType().add("location", "string").add("extraction_id", "string").add("path", "string")
             .add("actual_bytes", "long").add("actual_sha256", "string").add("actual_records", "long")
             .add("ends_with_newline", "boolean"))
PIECE_BYTES = 8 << 20
TASK_BYTES = 128 << 20


@dataclass
class _Files(InputPartition):
    locations: list[str]


def inspect_stream(stream, piece_bytes: int = PIECE_BYTES) -> tuple[int, str, int, bool]:
    """Bytes, SHA-256, newlines of a readable stream, and whether it is empty or ends with a newline."""
    size, digest, lines, last = 0, hashlib.sha256(), 0, b"\n"
    while piece := stream.read(piece_bytes):
        digest.update(piece)
        lines += piece.count(b"\n")
        size, last = size + len(piece), piece[-1:]
    return size, digest.hexdigest(), lines, last == b"\n"


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.piece_bytes = int(options.get("piecebytes", PIECE_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(((info.size, info.path) for info in found
                        if info.type == fs.FileType.File and info.base_name.endswith(self.suffix)
                        and not info.base_name.startswith(("_", "."))), reverse=True)
        tasks = max(1, min(len(files), -(-sum(size for size, _ in files) // self.task_bytes) + len(files) // 1000 + 8))
        loads = [(0, task, []) for task in range(tasks)]
        for size, path in files:
            load, task, mine = heapq.heappop(loads)
            mine.append(path)
            heapq.heappush(loads, (load + size, task, mine))
        return [_Files(mine) for _, _, mine in loads if mine]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(INSPECTED)
        system, _ = fs.FileSystem.from_uri(self.path)
        rows = []
        for location in partition.locations:
            folder, name = location.split("/")[-2:]
            with system.open_input_stream(location) as stream:
                rows.append((location, folder.rpartition("=")[2], name, *inspect_stream(stream, self.piece_bytes)))
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


class StagedFiles(DataSource):
    """``spark.read.format("staged_files").load(folder)``: one row for every file below a folder.

    Options: ``suffix`` of the file names, ``pieceBytes`` read at once, ``taskBytes`` a
    task is given.  The folder holding a file names its extraction, as ``<id>`` or ``<column>=<id>``.  Any store
    that Arrow can open by its URI will do; names that start with a dot or an underscore are no staged files.
    """

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> StructType:
        return INSPECTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def inspect_files(spark: SparkSession, folder: str, suffix: str = "", piece_bytes: int = PIECE_BYTES,
                  task_bytes: int = TASK_BYTES) -> DataFrame:
    """Columns ``INSPECTED`` for every file below ``folder``, empty ones included."""
    spark.dataSource.register(StagedFiles)
    return spark.read.format("staged_files").option("suffix", suffix).option("pieceBytes", piece_bytes).option(
        "taskBytes", task_bytes).load(folder)
