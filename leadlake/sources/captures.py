"""Streaming source of captures: folders that a crawler closes one after another.

A capture is a folder of Parquet files that counts once its marker ``_SUCCESS`` is there. Folders are
taken in the order of their names, each as a whole; one that is still open holds back all after it, so
none is ever skipped. The offset is the name of the last folder taken. The tasks read one row group each."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MARKER = "_SUCCESS"


def _filesystem(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int


class _Folders:
    """Complete captures under a folder, and their row groups."""

    def __init__(self, schema: StructType, options) -> None:
        self.schema, self.root = schema, options["path"].rstrip("/")
        self.closed = ""  # up to here all folders are known to be complete

    def names(self) -> list[str]:
        from pyarrow import fs
        files, root = _filesystem(self.root)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._")

    def last_closed(self) -> str:
        from pyarrow import fs
        files, root = _filesystem(self.root)
        open_or_closed = [n for n in self.names() if n > self.closed]
        marks = files.get_file_info([f"{root}/{n}/{MARKER}" for n in open_or_closed])
        for name, mark in zip(open_or_closed, marks, strict=True):
            if mark.type == fs.FileType.NotFound:
                break
            self.closed = name
        return self.closed

    def groups(self, after: str, to: str) -> list[RowGroup]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        files, root = _filesystem(self.root)
        out = []
        for name in self.names():
            if after < name <= to:
                for f in sorted(files.get_file_info(fs.FileSelector(f"{root}/{name}")), key=lambda f: f.path):
                    if f.type == fs.FileType.File and f.base_name.endswith(".parquet"):
                        with files.open_input_file(f.path) as source:
                            out += [RowGroup(f.path, g) for g in range(pq.ParquetFile(source).metadata.num_row_groups)]
        return out

    def read(self, partition: RowGroup | None) -> Iterator:
        """Record batches with the columns of the schema by name: others go, a column that a file lacks is null.

        Spark runs one task without a partition where there is no row group."""
        if partition is None:
            return
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        wanted = to_arrow_schema(self.schema)
        files, _ = _filesystem(self.root)
        with files.open_input_file(partition.path) as source:
            f = pq.ParquetFile(source)
            there = set(f.schema_arrow.names)
            columns = [n for n in wanted.names if n in there]
            for b in f.iter_batches(batch_size=1024, row_groups=[partition.group], columns=columns):
                yield pa.RecordBatch.from_arrays(
                    [b.column(x.name).cast(x.type) if x.name in there else pa.nulls(b.num_rows, x.type) for x in wanted], schema=wanted)


class _Batch(_Folders, DataSourceReader):
    def partitions(self):
        return self.groups("", self.last_closed())


class _Stream(_Folders, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"folder": ""}

    def latestOffset(self) -> dict:
        return {"folder": self.last_closed()}

    def partitions(self, start: dict, end: dict):
        self.closed = max(self.closed, end["folder"])  # after a restart: what was taken is complete
        return self.groups(start["folder"], end["folder"])


class CaptureFolders(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("capture_folders").schema(...).load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "capture_folders"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; its code travels with the jobs."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CaptureFolders)


def read_captures(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """All complete captures under ``root``; no rows where there are none."""
    register(spark)
    return spark.read.format("capture_folders").schema(schema).load(root)


def stream_captures(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The captures under ``root`` as a stream; each complete folder comes once, whole, in one batch."""
    register(spark)
    return spark.readStream.format("capture_folders").schema(schema).load(root)
