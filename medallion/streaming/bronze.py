"""Source -> bronze: append every row with its time of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..files import Files
from ..sources import stream_source
from ..spec import ARRIVAL, Layout, StreamSpec


def ensure_tables(spark: SparkSession, spec: StreamSpec, layout: Layout) -> None:
    """Make the table folders, so that readers find empty tables ahead of the first batch."""
    files = Files(spark)
    files.make_folder(layout.bronze(spec))
    files.make_folder(layout.silver(spec.table))


def start_bronze(spark: SparkSession, spec: StreamSpec, layout: Layout,
                 trigger: dict | None = None) -> StreamingQuery:
    """The parquet file sink lists its files per batch, so a replayed batch adds no row twice."""
    ensure_tables(spark, spec, layout)
    rows = stream_source(spark, spec).withColumn(ARRIVAL, F.current_timestamp())
    writer = (
        rows.writeStream.queryName(layout.bronze_query(spec)).format("parquet")
        .outputMode("append").option("checkpointLocation", layout.bronze_checkpoint(spec))
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start(layout.bronze(spec))


def read_bronze(spark: SparkSession, spec: StreamSpec, layout: Layout) -> DataFrame:
    return spark.read.schema(spec.table_schema).parquet(layout.bronze(spec))
