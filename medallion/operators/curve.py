"""The precision-recall curve of a score as a table, and the threshold it suggests.

Scores are counted first, then cut into ranges by approximate quantiles. Running sums are taken
within each range, and what lies above it is added from the ranges' totals, so no task sorts all
scores. The cuts decide where work goes, not what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def precision_recall_curve(scored: DataFrame, label: str, score: str = "score",
                           ranges: int = RANGES) -> DataFrame:
    """(score, tp, fp) for every different score: the rows of label 1 and of others that score as
    much or more. Rows without a score or a label are left out."""
    counts = (
        scored.select(F.col(score).cast("double").alias("score"), F.col(label).alias("label"))
        .dropna().groupBy("score")
        .agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") != 1).alias("fp"))
    )
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(counts.approxQuantile("score", shares, 1 / (4 * ranges)))) if shares else []
    # 0 is the range of the highest scores.
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut > F.col("score"))) \
        if cuts else F.lit(0)
    placed = counts.withColumn("place", place)
    above = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("place").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    # At most ``ranges`` rows: one task orders them, and they may be broadcast.
    before = totals.select("place", *[
        F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("tp", "fp")])
    within = Window.partitionBy("place").orderBy(F.desc("score"))
    sums = placed.select("place", "score", *[F.sum(c).over(within).alias(c) for c in ("tp", "fp")])
    return sums.join(F.broadcast(before), "place").select(
        "score", *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in ("tp", "fp")])


def f_measure(positives: Column) -> Column:
    """2 tp / (predicted + all positives) of a curve's row; NULL if there is neither."""
    below = F.col("tp") + F.col("fp") + positives
    return F.when(below > 0, 2 * F.col("tp") / below)


def best_threshold(curve: DataFrame) -> DataFrame:
    """(threshold, tp, fp, f1): the score from which on the F measure is largest; of equal ones the
    largest score. One row, or none of an empty curve."""
    positives = curve.agg(F.max("tp").alias("positives"))
    rated = curve.join(F.broadcast(positives)).withColumn("f1", f_measure(F.col("positives")))
    best = F.max(F.struct("f1", "score", "tp", "fp")).alias("best")
    return rated.agg(best).filter("best IS NOT NULL").select(
        F.col("best.score").alias("threshold"), "best.tp", "best.fp", "best.f1")
