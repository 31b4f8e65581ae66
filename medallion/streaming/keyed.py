"""Newest row per key, kept in Spark's state store.

The query's state is the table: one row per key, in RocksDB, with a checkpoint that Spark writes and
restores. A row replaces the one of its key if its ``order_by`` values (then all other columns) are
larger, whenever it arrives, so the table does not depend on how files were cut into batches.
Every batch gives the rows that it changed, for readers that follow the table; the table itself is
read from the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import any_null
from ..session import apart
from ..spec import Layout, StreamSpec
from .bronze import ensure_tables

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEWEST, COPIES = "_newest", "_copies"


def _parts(spec: StreamSpec) -> tuple[list[str], list[str]]:
    """Names of the other columns, those of the order first, and of the keys."""
    keys = list(spec.merge_keys)
    order = [c for c in spec.order_by if c not in keys]
    return [*order, *[c for c in spec.column_names if c not in keys and c not in order]], keys


def _aggregated(rows: DataFrame, spec: StreamSpec) -> DataFrame:
    """(keys, lone, newest, copies). A row with a NULL in a key matches nothing: ``lone`` makes it
    a group of its own, and equal ones are counted."""
    rest, keys = _parts(spec)
    value = F.struct(*[F.col(f"`{c}`") for c in rest])
    return rows.groupBy(*[F.col(f"`{k}`") for k in keys],
                        F.when(any_null(keys), value).alias("_lone")).agg(
        F.max(value).alias(NEWEST), F.count(F.lit(1)).alias(COPIES))


def _restored(state: DataFrame, spec: StreamSpec, schema) -> DataFrame:
    """Rows of the table from ``_aggregated`` ones."""
    _, keys = _parts(spec)
    rows = state.withColumn("_copy", F.explode(F.sequence(
        F.lit(1), F.when(F.col("_lone").isNull(), F.lit(1)).otherwise(F.col(COPIES).cast("int")))))
    return rows.select(*[
        (F.col(f"`{f.name}`") if f.name in keys else F.col(f"{NEWEST}.`{f.name}`"))
        .cast(f.dataType).alias(f.name) for f in schema.fields])


def start_keyed(spark: SparkSession, spec: StreamSpec, layout: Layout,
                trigger: dict | None = None,
                on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Carry bronze rows into the state of a query. ``on_change`` gets the rows of every key that a
    batch changed, and the batch's number; after a failure it may get a batch again.

    The state store is set for this query alone: a session of its own starts it.
    """
    if not spec.merge_keys:
        raise ValueError(f"{spec.table}: keyed state needs merge keys")
    ensure_tables(spark, spec, layout)
    own = apart(spark)
    own.conf.set(PROVIDER_CONF, ROCKSDB)
    rows = own.readStream.schema(spec.table_schema).parquet(layout.bronze(spec))

    def changed(batch: DataFrame, number: int) -> None:
        rows = _restored(batch, spec, spec.table_schema)
        if on_change:
            on_change(rows, number)
        else:
            batch.write.format("noop").mode("overwrite").save()

    writer = (
        _aggregated(rows.select(*spec.column_names), spec).writeStream
        .queryName(f"{layout.silver_query(spec)}-keyed").outputMode("update")
        .option("checkpointLocation", layout.keyed_checkpoint(spec)).foreachBatch(changed)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_keyed(spark: SparkSession, spec: StreamSpec, layout: Layout) -> DataFrame:
    """The table as of the last whole batch, read from the state's checkpoint by one task a state
    partition. A query must have run a batch."""
    rest, keys = _parts(spec)
    state = spark.read.format("statestore").load(layout.keyed_checkpoint(spec))
    names = [*keys, "_lone"]
    held = state.select(
        *[F.col(f"key.`{field.name}`").alias(name) for field, name
          in zip(state.schema["key"].dataType.fields, names)],
        *[F.col(f"value.`{field.name}`").alias(name) for field, name
          in zip(state.schema["value"].dataType.fields, [NEWEST, COPIES])])
    return _restored(held, spec, spec.table_schema)
