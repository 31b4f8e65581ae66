"""Column expressions. All of them are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, upper_bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first band whose (exclusive) upper bound is above ``value``.

    A NULL is below no bound, so it gets ``otherwise`` like every value past the last one.
    """
    label = None
    for bound, name in upper_bounds:
        below = value < F.lit(bound)
        label = F.when(below, name) if label is None else label.when(below, name)
    return F.lit(otherwise) if label is None else label.otherwise(otherwise)


def label_nulls(value: Column, label: str = "N/A") -> Column:
    return F.coalesce(value, F.lit(label))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, cut towards zero; NULL if one of them is."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def year_of(ts: Column) -> Column:
    return F.year(ts).cast("bigint")


def month_of(ts: Column) -> Column:
    return F.month(ts).cast("bigint")


def within_years(ts: Column, first: int, last: int) -> Column:
    """``first <= year(ts) <= last`` as a range on the bare column, which a scan can use."""
    return (ts >= F.lit(f"{first:04d}-01-01").cast("timestamp")) & (
        ts < F.lit(f"{last + 1:04d}-01-01").cast("timestamp")
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL where ``whole`` is 0 (also in ANSI mode)."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def hash_key(identity: Column, seed: str = "") -> Column:
    """md5 of the identity in hex: the same for a row on every run and in every engine, and
    evenly spread, also by its first characters."""
    return F.md5(F.concat(identity.cast("string"), F.lit(seed)))


def hash_number(identity: Column, seed: str = "") -> Column:
    """The first 60 bits of :func:`hash_key` as a bigint."""
    return F.conv(F.substring(hash_key(identity, seed), 1, 15), 16, 10).cast("bigint")


def row_as_json(columns: Sequence[str]) -> Column:
    """The row as one JSON document; NULL fields are left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
