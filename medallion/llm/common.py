"""What the operators share: cut lineage, folds, fresh names, ranks without a global sort."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_folder

WORD = r"[^\x20\x09-\x0D]+"  # fixed by the contracts: runs between ASCII white space


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder of ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a folder of its own. Spark
    deletes the files when the frame is no longer used, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_folder(spark, "checkpoints"))
    return df.checkpoint()


def computed(df: DataFrame) -> DataFrame:
    """``checkpointed``, and the shuffle files that it took are deleted at once. What ``df`` reads
    is computed again where a later query needs it."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")  # holds for frames that are made from now on
    try:
        return checkpointed(df.select("*"))
    finally:
        conf.set(key, before)


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """Column names that do not clash with ``taken``, whatever the caller's columns are called."""
    used = {c.lower() for c in taken}
    found = []
    for name in names:
        candidates = itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1)))
        choice = next(c for c in candidates if c.lower() not in used)
        used.add(choice.lower())
        found.append(choice)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(identity: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as the empty text."""
    text = F.coalesce(identity.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)).cast("int")


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on ``key`` alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double")
    return (bits + F.lit(0.5)) * F.lit(2.0**-53)


def count_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str,
           rows_per_task: int = 200_000) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``group``, by a hash of ``order`` and then ``order``.

    A group is cut into ranges of the hash, as many as its largest number of rows asks for, so
    no task ranks a whole hot group; the ranges' sizes, added up, give where each range begins.
    The order does not depend on the number of ranges. Rows equal in ``order`` share a range and
    are interchangeable. ``df`` is read twice: pass a checkpoint.
    """
    names = fresh(df.columns, "_hash", "_range", "_first", "_rows")
    hashed, piece, first, rows = names
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias(rows)).agg(F.max(rows)).first()[0]
    bits = min(40, max(0, math.ceil(math.log2(max(1, (largest or 0) / rows_per_task)))))
    keyed = df.withColumn(hashed, F.xxhash64(*[F.col(c) for c in order])).withColumn(
        piece, F.shiftright(F.col(hashed), 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*group, piece).agg(F.count(F.lit(1)).alias(rows))
        .withColumn(first, F.coalesce(F.sum(rows).over(before), F.lit(0)))
        .drop(rows)
    )
    within = Window.partitionBy(*group, piece).orderBy(hashed, *order)
    placed = keyed.withColumn(rank, (F.row_number().over(within) - 1).cast("long"))
    if not bits:
        return placed.drop(hashed, piece)
    keys = [*group, piece]
    other = starts.select(*[F.col(c).alias(f"{c}__s") for c in keys], first)
    same = [F.col(c).eqNullSafe(F.col(f"{c}__s")) for c in keys]
    return (
        placed.join(other, same)
        .withColumn(rank, F.col(rank) + F.col(first))
        .select(*df.columns, rank)
    )

