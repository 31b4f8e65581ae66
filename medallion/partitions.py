"""Tables with a folder per value of some columns, replaced folder by folder.

For columns of few values: a filter on them, or a join with a filtered table, reads only the folders
it needs, and a write replaces only the folders that it has rows for. Values are kept as they are:
the empty text and NULL have different folders, which Spark's plain partition columns do not give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "_by_"  # of the names of folders
MARK = "_"  # before every value, so that an empty one has a name


def _folder(column: str) -> str:
    return f"{PREFIX}{column}"


def with_folders(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``by`` turned into names of folders, NULL for NULL."""
    folders = [F.concat(F.lit(MARK), F.col(f"`{c}`").cast("string")).alias(_folder(c)) for c in by]
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in by], *folders)


def folder_schema(schema: T.StructType, by: Sequence[str]) -> T.StructType:
    """What files and folders of a table with ``schema`` hold."""
    fields = [f for f in schema.fields if f.name not in by]
    return T.StructType([*fields, *[T.StructField(_folder(c), T.StringType()) for c in by]])


def without_folders(rows: DataFrame, schema: T.StructType, by: Sequence[str]) -> DataFrame:
    """The columns of ``schema``, those in ``by`` from the names of folders. A filter on them is a
    filter on folders alone, so it decides which ones are listed."""
    return rows.select(*[
        F.substring(F.col(f"`{_folder(f.name)}`"), len(MARK) + 1, 1 << 30).cast(f.dataType)
        .alias(f.name) if f.name in by else F.col(f"`{f.name}`") for f in schema.fields])


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``rows`` to the table at ``path``: they replace all rows of the values of ``by`` that
    occur in them; other folders are left alone.

    Rows are dealt by value and a hash of the row, so that a value has few files and one with very
    many rows is written by several tasks.
    """
    if not by:
        raise ValueError("name the columns that have folders")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(8))
    dealt = rows.withColumn("_spread", spread).repartition(
        *[F.col(f"`{c}`") for c in by], "_spread").drop("_spread")
    (
        with_folders(dealt, by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*[_folder(c) for c in by]).parquet(path)
    )


def read_partitions(spark: SparkSession, path: str, schema: T.StructType | str,
                    by: Sequence[str]) -> DataFrame:
    """The table at ``path``, with its columns in the order of ``schema``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = spark.read.schema(folder_schema(schema, by)).parquet(path)
    return without_folders(rows, schema, by)
