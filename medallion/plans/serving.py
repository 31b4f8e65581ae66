"""Gold rows as JSON documents under a key, for readers outside Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import row_as_json
from ..spec import Layout
from ..versions import VersionedTable

ROW = T.StructType([T.StructField("row", T.StringType())])


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, NULL fields left out."""
    return df.select(row_as_json(df.columns).alias("row"))


def publish(spark: SparkSession, layout: Layout, key: str) -> None:
    """Replace the documents of ``key`` by the rows of its gold table; other keys are untouched.

    The rows go from executors to files; an empty result empties the key.
    """
    gold = VersionedTable(spark, layout.gold(key)).read()
    VersionedTable(spark, layout.cache(key)).replace(json_rows(gold))


def clear(spark: SparkSession, layout: Layout, key: str) -> None:
    VersionedTable(spark, layout.cache(key)).replace(spark.createDataFrame([], ROW))


def read(spark: SparkSession, layout: Layout, key: str) -> DataFrame:
    """The documents of a key: one column ``row``. No documents if it was never published."""
    return VersionedTable(spark, layout.cache(key)).read(ROW)


def read_rows(spark: SparkSession, layout: Layout, key: str,
              schema: T.StructType | str | None = None) -> DataFrame:
    """The documents of a key as columns, by default those of its gold table."""
    if schema is None:
        schema = VersionedTable(spark, layout.gold(key)).read().schema
    return (
        read(spark, layout, key).select(F.from_json("row", schema).alias("_row")).select("_row.*")
    )


def rows_of_months(rows: DataFrame, months: Sequence[int], column: str = "month") -> DataFrame:
    return rows.filter(F.col(column).isin([int(m) for m in months]))
