"""Streams and batches from files and message sources, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import StreamSpec
from . import message_log

CSV_OPTIONS = {"sep": ",", "header": "true"}
# The file source forgets files much older than the newest one and would skip late arrivals.
STREAM_OPTIONS = {"maxFileAge": "365000d"}
FILE_FORMATS = ("csv", "parquet", "json", "orc")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """A folder of comma-separated files with a header; a cell that does not parse is NULL."""
    return spark.read.options(**{**CSV_OPTIONS, **options}).schema(schema).csv(path)


def decode_payload(df: DataFrame, schema: T.StructType | str, payload: str = "value",
                   payload_format: str = "json") -> DataFrame:
    """Replace a text or binary ``payload`` column by the columns of ``schema``.

    A payload that does not parse gives NULL columns; no row is dropped.
    """
    text = F.col(payload).cast("string")
    ddl = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    if payload_format == "json":
        decoded = F.from_json(text, ddl)
    elif payload_format == "csv":
        decoded = F.from_csv(text, F.lit(ddl))
    else:
        raise ValueError(f"payload format {payload_format!r} is neither json nor csv")
    others = [c for c in df.columns if c != payload]
    return df.select(*others, decoded.alias("_payload")).select(*others, "_payload.*")


def stream_source(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """The unbounded source of ``spec``; the URL scheme of its path chooses the file system.

    File formats are read with the declared schema. Any other format is taken as a message
    source (its connector must be on the class path) whose ``value`` holds the row; columns of
    the message itself are taken along if ``message_columns`` names them.
    """
    reader = spark.readStream.format(spec.source_format)
    if spec.source_format in FILE_FORMATS:
        defaults = STREAM_OPTIONS | (CSV_OPTIONS if spec.source_format == "csv" else {})
        return (reader.options(**{**defaults, **spec.source_options})
                .schema(spec.source_schema).load(spec.source_path))
    if spec.source_format == message_log.FORMAT:
        message_log.register(spark)
    reader = reader.options(**spec.source_options)
    messages = reader.load(spec.source_path) if spec.source_path else reader.load()
    own = spec.message_columns
    payload = T.StructType([f for f in spec.source_schema if f.name not in own])
    rows = messages.select(*own, F.col("value").alias("_value"))
    decoded = decode_payload(rows, payload, "_value", spec.payload_format)
    return decoded.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in spec.source_schema])
