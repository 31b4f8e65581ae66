"""Keyed upsert of one batch, as a plain DataFrame operation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest_per_key


class DuplicateKeyError(ValueError):
    """A batch holds two rows for one key."""


def any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])


def keep_newest(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = (),
                on_duplicate: str = "last") -> DataFrame:
    """One row per key. Rows with a NULL in a key match nothing and are all kept.

    ``on_duplicate="last"`` keeps the row with the largest ``order`` values (then of all other
    columns); ``"error"`` raises if a key occurs twice.
    """
    keyed = batch.filter(~any_null(keys))
    if on_duplicate == "error":
        twice = keyed.groupBy(*keys).count().filter("count > 1").select(*keys).head(1)
        if twice:
            raise DuplicateKeyError(f"several rows for key {twice[0].asDict()}")
        return batch
    if on_duplicate != "last":
        raise ValueError(f"on_duplicate must be 'last' or 'error', not {on_duplicate!r}")
    return latest_per_key(keyed, keys, order).unionByName(batch.filter(any_null(keys)))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with its matched rows replaced by, and unmatched rows added from, ``source``.

    ``source`` must hold one row per key (:func:`keep_newest`). A small source is broadcast by
    its known size and the target is not shuffled. Target rows with a NULL key cannot match;
    they pass by the join, which would otherwise send them all to one task.
    """
    replaced = source.filter(~any_null(keys)).select(*keys)
    kept = target.filter(~any_null(keys)).join(replaced, list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(target.filter(any_null(keys))).unionByName(source.select(*target.columns))
