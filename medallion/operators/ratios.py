"""Distribution of a code given an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio


def conditional_distribution(coded: DataFrame, matches: DataFrame, on: str, code: str) -> DataFrame:
    """How often each ``code`` occurs among the pairs of ``coded`` and ``matches`` rows that
    share ``on``, as a share of all such pairs: columns ``code``, ``cases``, ``ratio``.

    The pairs are counted, never listed: ``matches`` is first reduced to one weighted row per
    ``on``, so a value with many rows on both sides costs their sum, not their product. Spark
    broadcasts the weights once their measured size allows it; a hot value is split as skew.
    """
    weights = matches.groupBy(on).agg(F.count(F.lit(1)).alias("_weight"))
    cases = (
        coded.select(on, code).join(weights, on)
        .groupBy(code).agg(F.sum("_weight").alias("cases"))
    )
    # The total reads the shuffle of `cases` again (a reused exchange), not the tables.
    total: Column = cases.agg(F.sum("cases").alias("total")).scalar()
    return cases.withColumn("ratio", ratio(F.col("cases"), total))
