"""Bronze -> silver: append each batch, or upsert it by key.

A batch is a folder of parquet files, ``_stream=<number>-<id>/_batch=<number>``, that Spark writes
and finds again as partitions; there is no other record. A batch that failed is overwritten, one
that Spark has marked as whole is left alone, so a replay changes nothing. While a batch is being
committed its files appear one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..files import Files
from ..operators.upsert import keep_newest
from ..partitions import folder_schema, with_folders, without_folders
from ..spec import APPEND, MERGE, Layout, StreamSpec
from .bronze import ensure_tables

STREAM, BATCH = "_stream", "_batch"
WHOLE = "_SUCCESS"


def _clustered(rows: DataFrame, columns: Sequence[str], spec: StreamSpec) -> DataFrame:
    """Files that hold ranges of ``columns``, so that a lookup skips most of them by their
    statistics. The hash lets one value with many rows span several files."""
    if not columns:
        return rows
    near = [F.col(f"`{c}`") for c in columns]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in spec.column_names])
    return rows.repartitionByRange(*near, spread).sortWithinPartitions(*near)


def _streams(files: Files, path: str) -> list[str]:
    """Folders of the streams that have written to a table, in the order they came."""
    return sorted(name for name in files.names(path) if name.startswith(f"{STREAM}="))


def _by(spec: StreamSpec) -> tuple[str, ...]:
    """Columns with a folder per value. Rows that are merged may change theirs, so only the rows of
    appended tables have such folders."""
    return spec.partition_by if spec.method == APPEND else ()


def _add(rows: DataFrame, spec: StreamSpec, layout: Layout, stream: str, number: int) -> None:
    """Write a batch to a folder of its own, unless it is there already."""
    files, path = Files(rows.sparkSession), layout.silver(spec.table)
    there = _streams(files, path)
    own = next((name for name in there if name.partition("-")[2] == stream),
               f"{STREAM}={len(there):06d}-{stream}")
    folder = f"{path}/{own}/{BATCH}={number}"
    if WHOLE in files.names(folder):
        return
    by = _by(spec)
    writer = with_folders(rows, by).write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*[f.name for f in folder_schema(rows.schema, by)
                                      if f.name not in rows.columns])
    writer.parquet(folder)


def merge_batch(batch: DataFrame, spec: StreamSpec, layout: Layout, stream: str,
                number: int) -> None:
    """Upsert ``batch`` into the silver table: its rows replace those of the same key.

    Only the batch's rows are written, one per key; reading lets the last batch win. For tables
    with a long history of changes use the keyed state, whose size follows the keys.
    """
    rows = keep_newest(batch.select(*spec.column_names), spec.merge_keys, spec.order_by,
                       spec.on_duplicate)
    _add(_clustered(rows, spec.partition_by, spec), spec, layout, stream, number)


def append_batch(batch: DataFrame, spec: StreamSpec, layout: Layout, stream: str,
                 number: int) -> None:
    """Add the declared columns of ``batch``: a folder per value of ``partition_by``, in it files
    that hold ranges of ``cluster_by``."""
    near = list(dict.fromkeys([*spec.partition_by, *spec.cluster_by]))
    _add(_clustered(batch.select(*spec.column_names), near, spec), spec, layout, stream, number)


def read_silver(spark: SparkSession, spec: StreamSpec, layout: Layout) -> DataFrame:
    """The rows of all batches; of a merge table the last batch's row of every key, and all rows
    with a NULL in a key, which match nothing. A filter on ``partition_by`` of an appended table
    decides which folders are read."""
    files, path, by = Files(spark), layout.silver(spec.table), _by(spec)
    streams = _streams(files, path)
    if not streams:
        return spark.createDataFrame([], spec.table_schema)
    schema = T.StructType([*folder_schema(spec.table_schema, by).fields,
                           T.StructField(STREAM, T.StringType()),
                           T.StructField(BATCH, T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    if spec.method != MERGE:
        return without_folders(rows, spec.table_schema, by)
    if len(streams) > 1 or len(files.names(f"{path}/{streams[0]}")) > 1:
        rows = keep_newest(rows, spec.merge_keys, [STREAM, BATCH])
    return rows.select(*spec.column_names)


def start_silver(spark: SparkSession, spec: StreamSpec, layout: Layout,
                 trigger: dict | None = None) -> StreamingQuery:
    ensure_tables(spark, spec, layout)
    write = merge_batch if spec.method == MERGE else append_batch

    def on_batch(batch: DataFrame, number: int) -> None:
        # The id belongs to the checkpoint: it outlives restarts, and a new checkpoint, which
        # counts its batches from 0 again, gets a new one.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write(batch, spec, layout, stream, number)

    writer = (
        spark.readStream.schema(spec.table_schema).parquet(layout.bronze(spec))
        .writeStream.queryName(layout.silver_query(spec)).outputMode("update")
        .option("checkpointLocation", layout.silver_checkpoint(spec))
        .foreachBatch(on_batch)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
