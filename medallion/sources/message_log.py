"""A message source for Structured Streaming: topics that are kept as segments in a folder.

A producer appends whole segments (:func:`publish`); Spark reads them through its Python data
source interface. The offset of a stream is the number of the last segment read, which Spark keeps
in the query's checkpoint: after a restart the same segments make up the same batch again. A
segment counts from the moment its job has been committed, so half-written ones are never read. A
run until nothing is left that begins with the replay of a failed batch ends behind it; the segments
that came since are taken by the next run.

Files are opened by ``pyarrow.fs``: the folder may lie on any store it knows (``file``, ``s3``,
``gs``, ``hdfs``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "message_log"
SCHEMA = "key string, value binary, segment bigint, offset bigint, timestamp timestamp"
SEGMENT = "segment="
DONE = "_SUCCESS"

# Executors need not have the package: what runs in them travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if ":" not in path.split("/", 1)[0]:
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _names(path: str) -> list[tuple[str, str, int]]:
    """(name, full path, size) of what lies in a folder; nothing if there is none."""
    files, folder = _opened(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return [(f.base_name, f.path, f.size) for f in found]


def _segments(path: str, after: int) -> list[int]:
    """Numbers of the committed segments after one, without a gap: a segment that is still being
    written holds back those behind it."""
    there = sorted(int(name[len(SEGMENT):]) for name, _, _ in _names(path)
                   if name.startswith(SEGMENT) and int(name[len(SEGMENT):]) > after)
    found = []
    for number in there:
        if not any(name == DONE for name, _, _ in _names(f"{path}/{SEGMENT}{number:012d}")):
            break
        found.append(number)
    return found


def publish(messages: DataFrame, path: str, key: Column | None = None,
            value: Column | None = None) -> int:
    """Append ``messages`` as one segment and return its number; one producer at a time.

    ``value`` (by default the column of that name) is the payload. A segment that a failed job left
    is written anew.
    """
    done = _segments(path, -1)
    number = done[-1] + 1 if done else 0
    rows = messages.select(
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        (F.col("value") if value is None else value).cast("binary").alias("value"),
        F.current_timestamp().alias("timestamp"))
    rows.write.mode("overwrite").parquet(f"{path}/{SEGMENT}{number:012d}")
    return number


@dataclass
class _Rows(InputPartition):
    """Row groups of a segment's file; ``first`` is the offset of the file's first message."""

    path: str
    segment: int
    groups: tuple[int, ...]
    first: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.start = options.get("startingOffsets", "earliest")
        if self.start not in ("earliest", "latest"):
            raise ValueError("startingOffsets is 'earliest' or 'latest'")
        self.begin: int | None = None
        self.seen = -1

    def initialOffset(self) -> dict:
        """Asked for once, when a query has no checkpoint yet; maybe after ``latestOffset``."""
        if self.begin is None:
            self.begin = max(_segments(self.path, -1), default=-1) if self.start == "latest" else -1
        return {"segment": self.begin}

    def latestOffset(self) -> dict:
        if self.seen < 0:
            self.seen = self.initialOffset()["segment"]
        self.seen = max(_segments(self.path, self.seen), default=self.seen)
        return {"segment": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One per row group, so that a large file is read by several tasks."""
        self.seen = max(self.seen, end["segment"])
        parts = []
        for number in range(start["segment"] + 1, end["segment"] + 1):
            first = 0
            for name, path, _ in sorted(_names(f"{self.path}/{SEGMENT}{number:012d}")):
                if not name.endswith(".parquet"):
                    continue
                files, _ = _opened(self.path)
                with files.open_input_file(path) as source:
                    about = pq.ParquetFile(source).metadata
                    sizes = [about.row_group(i).num_rows for i in range(about.num_row_groups)]
                for group, size in enumerate(sizes):
                    parts.append(_Rows(path, number, (group,), first))
                    first += size
        return parts

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        with files.open_input_file(partition.path) as source:
            at = partition.first
            for batch in pq.ParquetFile(source).iter_batches(
                    row_groups=list(partition.groups), columns=["key", "value", "timestamp"]):
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").cast(pa.string()), batch.column("value").cast(pa.binary()),
                    pa.array([partition.segment] * size, pa.int64()),
                    pa.array(range(at, at + size), pa.int64()),
                    batch.column("timestamp").cast(pa.timestamp("us", "UTC"))],
                    ["key", "value", "segment", "offset", "timestamp"])
                at += size

    def commit(self, end: dict) -> None:
        """Segments are kept: other queries may read them."""


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").load(folder)``: key, value, segment, offset and
    timestamp of every message. Options: ``startingOffsets`` (earliest, latest)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)
