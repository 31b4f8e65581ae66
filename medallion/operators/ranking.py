"""Latest row per key, top n per group, top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row with the largest ``order`` values for each key.

    Ties are broken by the remaining columns, so the result does not depend on the
    layout of the data. Written as an aggregate, not as a window: each map task sends
    at most one row per key, so a key holding a third of the rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not order and not rest:
        return df.distinct()
    newest = F.max(F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])).alias("_newest")
    rows = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(newest)
    return rows.select(*[
        F.col(f"`{c}`") if c in keys else F.col(f"_newest.`{c}`").alias(c) for c in df.columns
    ])


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                    rank: str = "ROW_NUMBER") -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    ``order`` must be total within a group. The literal bound lets Spark keep only n rows
    per group and task ahead of the shuffle (WindowGroupLimit).
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.col(rank).cast("bigint"))
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps a heap of k rows, nothing is sorted whole."""
    return df.orderBy(*order).limit(k)


def sort_bounded(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort a result whose number of rows is bounded by its definition, such as one row per
    band or year: in one task, without the sampling job of a range partitioning."""
    return df.coalesce(1).orderBy(*order)
