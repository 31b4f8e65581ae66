"""Published rows as VARIANT documents: filtered by path, then made columns.

A collection holds the rows of several tables side by side, so its documents differ in shape. A
document is stored in Spark's binary VARIANT, not as text: nothing is parsed, a filter looks up one
path, and both the filter and the paths that become columns reach the scan.

A path that a document lacks, or whose value can't be cast to the type asked for, is NULL: such
documents pass no filter and have NULL in that column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Layout
from ..versions import VersionedTable

DOCUMENT = T.StructType([T.StructField("document", T.VariantType())])
_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def as_documents(df: DataFrame) -> DataFrame:
    """One document per row; NULL columns are fields that hold null."""
    return df.select(F.to_variant_object(F.struct("*")).alias("document"))


def publish(spark: SparkSession, layout: Layout, collection: str,
            tables: Sequence[DataFrame]) -> None:
    """Replace the documents of ``collection`` by the rows of all ``tables``; no table empties it."""
    empty = spark.createDataFrame([], DOCUMENT)
    documents = reduce(DataFrame.unionAll, map(as_documents, tables), empty)
    VersionedTable(spark, layout.documents(collection)).replace(documents)


def read(spark: SparkSession, layout: Layout, collection: str) -> DataFrame:
    """The documents of a collection; none if it was never published."""
    return VersionedTable(spark, layout.documents(collection)).read(DOCUMENT)


def _path(name: str) -> str:
    """The path of a field. Spark's paths have no escapes, so a name can't hold both quotes."""
    for quote in "\"'":
        if quote not in name:
            return f"$[{quote}{name}{quote}]"
    raise ValueError(f"no path leads to a field with both quotes in its name: {name}")


def field(name: str, data_type: str) -> Column:
    return F.try_variant_get("document", _path(name), data_type)


def having(documents: DataFrame, name: str, values: Sequence[bool | int | float | str]) -> DataFrame:
    """The documents whose field ``name`` is one of ``values``, which share one type."""
    kinds = {type(v) for v in values}
    if not values:
        return documents.limit(0)
    if len(kinds) > 1 or not kinds <= set(_TYPES):
        raise ValueError("values must be of one type: bool, int, float or str")
    return documents.filter(field(name, _TYPES[kinds.pop()]).isin(list(values)))


def as_columns(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """The documents' fields as columns of ``schema``."""
    return documents.select(*[
        field(f.name, f.dataType.simpleString()).alias(f.name) for f in schema])
