"""Exact, repeatable sampling for imbalanced two-class data.

Rows are ordered by a hash of their identity. "The n rows with the lowest hash" is found
without sorting the table: a histogram over 2^16 hash buckets gives the bucket in which the
n-th row lies, and only the rows of that bucket are ranked. The sample is then a per-row
comparison with the hash and identity of the n-th row. Identities must be unique and not NULL:
where a repeated one would make a sample larger or a draw ambiguous, the query fails.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_key, hash_number

BUCKET_DIGITS = 4  # of the hash, in hex


def _keyed(df: DataFrame, identity: str, label: str, seed: str) -> DataFrame:
    h = hash_key(F.col(identity), seed)
    return (
        df.select(F.col(identity).alias("_id"), F.col(label).alias("_class"), h.alias("_h"))
        .withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    )


def _histogram(keyed: DataFrame) -> DataFrame:
    """Rows per class and bucket, with the number of rows in the buckets before it.

    At most 2^16 rows per class, whatever the size of the table.
    """
    before = (
        Window.partitionBy("_class").orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("_class")
    return (
        keyed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(whole))
    )


def _unless_repeated(value: Column, neighbour: Column) -> Column:
    """``value`` of a row, or an error if its neighbour in hash order has the same identity."""
    message = F.concat(F.lit("identities must be unique; repeated: "), F.col("_id").cast("string"))
    return F.when(neighbour == F.col("_id"), F.raise_error(message).cast("string")).otherwise(value)


def _cut_points(keyed: DataFrame, quota: Column) -> DataFrame:
    """Per class the hash and identity of its last chosen row (no row where the quota is 0).

    ``quota`` is an expression over ``_class`` and ``_total``.
    """
    border = (
        _histogram(keyed).withColumn("_quota", quota)
        .filter((F.col("_before") < F.col("_quota"))
                & (F.col("_before") + F.col("_rows") >= F.col("_quota")))
        .select("_class", "_bucket", (F.col("_quota") - F.col("_before")).alias("_place"))
    )
    in_border = keyed.join(border, ["_class", "_bucket"])
    order = Window.partitionBy("_class").orderBy("_h", "_id")
    return (
        in_border.withColumn("_n", F.row_number().over(order))
        .withColumn("_next", F.lead("_id").over(order))
        .filter(F.col("_n") == F.col("_place"))
        .select("_class", _unless_repeated(F.col("_h"), F.col("_next")).alias("_cut_h"),
                F.col("_id").alias("_cut_id"))
    )


def _place(h: Column, identity: Column) -> Column:
    """Hash and identity as one ordered value, so that the hash is computed once per row."""
    return F.struct(h.alias("h"), identity.alias("id"))


def split_by_class(df: DataFrame, identity: str, label: str, test_share: float = 0.2,
                   seed: str = "42", part: str = "part") -> DataFrame:
    """Stratified split: ``part`` is 'test' for round(test_share * n) rows of each class."""
    keyed = _keyed(df, identity, label, seed)
    quota = F.floor(F.lit(float(test_share)) * F.col("_total") + F.lit(0.5))
    cuts = _cut_points(keyed, quota).withColumnRenamed("_class", label)
    chosen = _place(hash_key(F.col(identity), seed), F.col(identity)) <= _place(
        F.col("_cut_h"), F.col("_cut_id"))
    return (
        df.join(cuts, label, "left")
        .withColumn(part, F.when(chosen, "test").otherwise("train"))
        .select(*df.columns, part)
    )


def _two_classes(df: DataFrame, identity: str, label: str):
    """(minority label, its rows, majority label, its rows); two rows reach the driver."""
    counts = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("count"), F.count(identity).alias("known")
    ).orderBy("count", label).limit(3).collect()
    if len(counts) != 2 or counts[0][label] is None or counts[1][label] is None:
        raise ValueError(f"{label} must hold exactly two classes and no NULL")
    if any(r["known"] < r["count"] for r in counts):
        raise ValueError(f"{identity} must not be NULL")
    (minor, n_minor, _), (major, n_major, _) = counts
    return minor, n_minor, major, n_major


def _lowest(df: DataFrame, identity: str, label: str, wanted: int, seed: str) -> Column:
    """Condition for the ``wanted`` rows of lowest hash of ``df``, which holds one class."""
    cut = _cut_points(_keyed(df, identity, label, seed), F.lit(wanted)).first()
    if cut is None:
        return F.lit(False)
    last = _place(F.lit(cut._cut_h), F.lit(cut._cut_id).cast(df.schema[identity].dataType))
    return _place(hash_key(F.col(identity), seed), F.col(identity)) <= last


def _draws(minority: DataFrame, identity: str, label: str, n: int, extra: int,
           seed: str) -> DataFrame:
    """``extra`` draws with replacement from the ``n`` rows: draw i takes the row at place
    hash(i) mod n in hash order. Identities are placed, per hash bucket, and draws are counted per
    place; the rows themselves are shuffled only to meet their number of draws."""
    keyed = _keyed(minority, identity, label, seed)
    starts = _histogram(keyed).select("_bucket", "_before")
    in_bucket = Window.partitionBy("_bucket").orderBy("_h", "_id")
    placed = (
        keyed.withColumn("_n", F.row_number().over(in_bucket))
        .withColumn("_last", F.lag("_id").over(in_bucket))
        .join(starts, "_bucket")
        .select("_id", _unless_repeated(F.col("_before") + F.col("_n") - 1, F.col("_last"))
                .cast("bigint").alias("_place"))
    )
    times = minority.sparkSession.range(extra).select(
        F.pmod(hash_number(F.col("id"), seed), F.lit(n)).alias("_place")
    ).groupBy("_place").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    drawn = placed.join(times, "_place").select("_id", "_times")
    return (
        minority.select(F.struct("*").alias("_row"))
        .join(drawn, F.col("_row")[identity] == F.col("_id"))
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select("_row.*")
    )


def resample(df: DataFrame, identity: str, label: str, over: float | None = None,
             under: float | None = None, seed: str = "42") -> DataFrame:
    """Bring minority / majority first to ``over`` by drawing minority rows again, then to
    ``under`` by leaving majority rows out. The sizes of both steps follow from one count."""
    minor, n_minor, major, n_major = _two_classes(df, identity, label)
    minority = df.filter(F.col(label) == F.lit(minor))
    extra = 0 if over is None else math.floor(over * n_major) - n_minor
    if extra < 0:
        raise ValueError(f"minority / majority is above {over} already")
    result = df
    if under is not None:
        wanted = math.floor((n_minor + extra) / under)
        if wanted > n_major:
            raise ValueError(f"minority / majority is above {under} already")
        majority = df.filter(F.col(label) == F.lit(major))
        kept = _lowest(majority, identity, label, wanted, seed)
        result = df.filter((F.col(label) == F.lit(minor)) | kept)
    if extra:
        result = result.unionByName(_draws(minority, identity, label, n_minor, extra, seed))
    return result


def oversample(df: DataFrame, identity: str, label: str, target: float = 0.4,
               seed: str = "42") -> DataFrame:
    """All rows, and draws with replacement from the minority up to floor(target * majority)."""
    return resample(df, identity, label, over=target, seed=seed)


def undersample(df: DataFrame, identity: str, label: str, target: float = 0.6,
                seed: str = "42") -> DataFrame:
    """All minority rows and the floor(minority / target) majority rows of lowest hash."""
    return resample(df, identity, label, under=target, seed=seed)
