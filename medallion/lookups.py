"""Tables that are made for lookups and for joins of two fact tables.

Lookups: files carry a Bloom filter per column and row group, so a search for some values opens only
the row groups that may hold them, however the rows are ordered. Many values, as a table, are joined;
Spark then filters the rows by a Bloom filter of the values ahead of the shuffle.

Joins: tables that share buckets of a key are joined on it without being shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_LISTED = 1000  # values that are looked up by a filter; more are joined
# A filter on more values than this would be pushed to the files as a range.
LISTED_CONF = "spark.sql.parquet.pushdown.inFilterThreshold"


def write_lookup(rows: DataFrame, path: str, columns: Sequence[str], different: int = 100_000,
                 mode: str = "append", row_group_bytes: int | None = None) -> None:
    """Write ``rows`` with Bloom filters on ``columns``, for up to ``different`` values a row group
    each (about 1.2 bytes a value)."""
    writer = rows.write.mode(mode)
    for column in columns:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{column}", str(different)))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def rows_of(spark: SparkSession, path: str, schema: T.StructType | str, column: str,
            wanted: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """The rows of a lookup table whose ``column`` has a value of ``wanted``, which has that column.

    Up to ``most_listed`` different values are fetched and become a filter, which the files' Bloom
    filters answer; more are joined, by Spark's choice of strategy. NULL finds nothing. Values may
    repeat; rows are given once.
    """
    rows = spark.read.schema(schema).parquet(path)
    values = wanted.select(column).filter(F.col(column).isNotNull()).distinct()
    few = values.limit(most_listed + 1).collect()
    if len(few) > most_listed:
        return rows.join(values, column, "left_semi").select(*rows.columns)
    if len(few) > int(spark.conf.get(LISTED_CONF)):
        spark.conf.set(LISTED_CONF, str(most_listed))
    return rows.filter(F.col(column).isin([r[0] for r in few]))


def write_buckets(rows: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write ``rows`` to ``path`` in ``buckets`` of ``keys``, each sorted by them, as table ``name``.

    Rows are dealt by the same hash first, so there is one file per bucket. Choose the same number
    of buckets for tables that are joined, so many that a bucket fits a task.
    """
    (
        rows.repartition(buckets, *[F.col(f"`{k}`") for k in keys]).write.mode("overwrite")
        .bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    )


class BucketedTables:
    """Tables of a project of which some are read from buckets.

    ``buckets`` maps a table to the name it was written under; the others, and columns that the
    buckets do not hold, are read from ``tables``.
    """

    def __init__(self, spark: SparkSession, tables, buckets: dict[str, str]):
        self.spark, self.tables, self.buckets = spark, tables, buckets

    def __call__(self, name: str, *columns: str) -> DataFrame:
        if name in self.buckets:
            rows = self.spark.table(self.buckets[name])
            if set(columns) <= set(rows.columns) and columns:
                return rows.select(*columns)
        return self.tables(name, *columns)

    def names(self) -> list[str]:
        return self.tables.names()

    def on(self, spark: SparkSession) -> BucketedTables:
        return BucketedTables(spark, self.tables.on(spark), self.buckets)
