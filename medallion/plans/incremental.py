"""Gold tables that are brought up to date by new rows alone.

An incremental analysis is a set of mergeable states per group (counts, sums, smallest and largest
values or structs) and a finish that turns them into the result. A refresh is a run of a streaming
query over the bronze table: Spark's checkpoint tells which files are new, its state store holds the
states, and only the new rows are aggregated into them. What a refresh costs follows the rows that
came since the last one and the number of groups, not the size of the table.

Only append tables can be followed this way: an upsert takes rows away, which a count, a sum or a
largest value cannot undo without the rows themselves.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import APPEND, Layout, StreamSpec
from ..streaming.control import AVAILABLE_NOW
from ..streaming.keyed import PROVIDER_CONF, ROCKSDB
from ..session import apart
from ..versions import VersionedTable
from . import serving
from .gold import Materialised, RefreshError


@dataclass(frozen=True)
class Incremental:
    """``states`` are aggregates, by name and as SQL, per ``group`` (columns or SQL) over the rows of
    one append table; ``prepare`` may derive columns row by row; ``finish`` gets (group, states),
    one row per group."""

    states: Mapping[str, str]
    group: Sequence[str] = ()
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda states: states)

    def partial(self, rows: DataFrame) -> DataFrame:
        aggregates = [F.expr(sql).alias(name) for name, sql in self.states.items()]
        return self.prepare(rows).groupBy(*map(F.expr, self.group)).agg(*aggregates)


class IncrementalGold:
    """The incremental analyses over one append table, each a gold table under its key."""

    def __init__(self, spark: SparkSession, layout: Layout, spec: StreamSpec,
                 definitions: Mapping[str, Incremental]):
        if spec.method != APPEND:
            raise ValueError(f"{spec.table}: only append tables can be followed")
        self.spark, self.layout, self.spec = spark, layout, spec
        self.definitions = dict(definitions)

    def refresh(self, keys: Iterable[str] | None = None, to_cache: bool = True,
                parallel: int = 4) -> dict[str, Materialised]:
        """Take in what has arrived since each key's last refresh and replace its gold table and
        documents. A key without new rows keeps them. One that fails stops no other; its states
        stay as they were, so the next refresh takes in the same rows again."""
        chosen = list(dict.fromkeys(keys if keys is not None else self.definitions))
        results, errors = {}, {}
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            jobs = {key: pool.submit(inheritable_thread_target(self.spark)(self._refresh), key,
                                     to_cache) for key in chosen}
            for key, job in jobs.items():
                try:
                    results[key] = job.result()
                except Exception as error:
                    errors[key] = error
        if errors:
            raise RefreshError(errors)
        return {key: done for key, done in results.items() if done}

    def _refresh(self, key: str, to_cache: bool) -> Materialised | None:
        definition, began, paths = self.definitions[key], time.monotonic(), []
        table = VersionedTable(self.spark, self.layout.gold(key))

        def replace(states: DataFrame, _: int) -> None:
            # Runs again with the same states if the query failed behind it.
            paths.append(table.replace(definition.finish(states)))

        own = apart(self.spark)
        own.conf.set(PROVIDER_CONF, ROCKSDB)
        rows = own.readStream.schema(self.spec.table_schema).parquet(self.layout.bronze(self.spec))
        query = (
            definition.partial(rows).writeStream.outputMode("complete")
            .queryName(f"{self.layout.project}-refresh-{key}")
            .option("checkpointLocation", self.layout.refresh_checkpoint(key))
            .trigger(**AVAILABLE_NOW).foreachBatch(replace).start()
        )
        query.awaitTermination()
        if not paths:
            return None
        if to_cache:
            serving.publish(self.spark, self.layout, key)
        return Materialised(paths[-1], time.monotonic() - began)

    def full(self, key: str) -> DataFrame:
        """The same result from all rows at once."""
        rows = self.spark.read.schema(self.spec.table_schema).parquet(
            self.layout.bronze(self.spec))
        definition = self.definitions[key]
        return definition.finish(definition.partial(rows))
