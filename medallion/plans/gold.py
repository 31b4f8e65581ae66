"""Saved SQL and named analyses over silver, materialised as gold tables under a key."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..files import Files
from ..session import apart, work_folder
from ..spec import Layout, SavedQuery, StreamSpec, by_table
from ..streaming.silver import read_silver
from ..versions import VersionedTable
from . import serving

Tables = Callable[..., DataFrame]
Definition = SavedQuery | Callable[[Tables], DataFrame]


class SilverTables:
    """``tables(name, *columns)`` reads a project's silver table, all columns by default."""

    def __init__(self, spark: SparkSession, layout: Layout, specs: Iterable[StreamSpec]):
        self.spark, self.layout, self.specs = spark, layout, by_table(list(specs))

    def __call__(self, name: str, *columns: str) -> DataFrame:
        df = read_silver(self.spark, self.specs[name], self.layout)
        return df.select(*columns) if columns else df

    def names(self) -> list[str]:
        return list(self.specs)

    def on(self, spark: SparkSession) -> SilverTables:
        """The same tables, read by another session."""
        return SilverTables(spark, self.layout, self.specs.values())


def with_views(spark: SparkSession, tables, sql: str) -> SparkSession:
    """A session of its own in which the tables that ``sql`` may name have their bare names.

    Statements of several projects may run at once, and views of the caller stay as they are.
    The other tables are left alone: finding the files of a large table takes time too.
    """
    words = {word.lower() for word in re.findall(r"\w+", sql)}
    own = apart(spark)
    theirs = tables.on(own)
    for name in tables.names():
        if name.lower() in words:
            theirs(name).createOrReplaceTempView(name)
    return own


def run_sql(spark: SparkSession, tables, sql: str, args: Mapping | None = None) -> DataFrame:
    """A user's SQL over the tables of a project; values go into ``args``, not into the text.

    It sees the project's tables and no view of the caller's session.
    """
    return with_views(spark, tables, sql).sql(sql, args=dict(args) if args else None)


@dataclass(frozen=True)
class Answer:
    rows: DataFrame  # one JSON document per row
    seconds: float
    path: str

    def discard(self) -> None:
        """Delete the documents, when the caller has read them."""
        Files(self.rows.sparkSession).delete(self.path)


def answer(spark: SparkSession, tables, sql: str, args: Mapping | None = None) -> Answer:
    """Run a user's SQL to its end and tell how long it took, planning included.

    The documents lie in the shared work folder, for the caller to page through.
    """
    began = time.monotonic()
    path = work_folder(spark, "answer")
    serving.json_rows(run_sql(spark, tables, sql, args)).write.parquet(path)
    return Answer(spark.read.schema(serving.ROW).parquet(path), time.monotonic() - began, path)


def describe(spark: SparkSession, tables, name: str) -> DataFrame:
    """Columns of a table as rows: col_name, data_type, comment."""
    own = with_views(spark, tables, name)
    return own.sql(f"DESCRIBE TABLE `{name}`").select("col_name", "data_type", "comment")


@dataclass(frozen=True)
class Materialised:
    path: str
    seconds: float


def materialise(spark: SparkSession, tables, layout: Layout, key: str,
                definition: Definition) -> Materialised:
    """Run a definition and make its rows the gold table of ``key``, whatever their schema was
    before. Readers see the old rows until the new ones are complete."""
    began = time.monotonic()
    df = (run_sql(spark, tables, definition.sql) if isinstance(definition, SavedQuery)
          else definition(tables))
    path = VersionedTable(spark, layout.gold(key)).replace(df)
    return Materialised(path, time.monotonic() - began)


def read_gold(spark: SparkSession, layout: Layout, key: str) -> DataFrame:
    return VersionedTable(spark, layout.gold(key)).read()


class RefreshError(Exception):
    """Some definitions failed; ``errors`` holds the exception of each key."""

    def __init__(self, errors: dict[str, Exception]):
        self.errors = errors
        super().__init__("; ".join(f"{key}: {error}" for key, error in errors.items()))


class _WithStored:
    """Tables of a project and, by name, the intermediate results stored for a refresh."""

    def __init__(self, tables, stored: dict[str, DataFrame]):
        self._tables, self.stored = tables, stored

    def __call__(self, name: str, *columns: str) -> DataFrame:
        return self._tables(name, *columns)

    def names(self) -> list[str]:
        return self._tables.names()

    def on(self, spark: SparkSession) -> _WithStored:
        return _WithStored(self._tables.on(spark), self.stored)


class Registry:
    """The saved queries and analyses of a project; each key has one current definition.

    ``shared`` names intermediate results and the keys that start from them.
    """

    def __init__(self, spark: SparkSession, tables, layout: Layout,
                 definitions: Mapping[str, Definition] | None = None,
                 shared: Mapping[Callable[[Tables], DataFrame], Iterable[str]] | None = None):
        self.spark, self.tables, self.layout = spark, tables, layout
        self.definitions: dict[str, Definition] = dict(definitions or {})
        self.shared = {function: set(keys) for function, keys in (shared or {}).items()}

    def save(self, query: SavedQuery) -> None:
        self.definitions[query.key] = query

    def register_and_run(self, query: SavedQuery) -> Materialised:
        """Save a query, materialise it and publish its rows for the first time."""
        self.save(query)
        return self.refresh([query.key])[query.key]

    def refresh(self, keys: Iterable[str] | None = None, to_gold: bool = True,
                to_cache: bool = True, parallel: int = 4) -> dict[str, Materialised]:
        """Run definitions again (all of them by default): the job a scheduler calls.

        An intermediate result that several of them start from is computed once and stored.
        Keys do not depend on each other: up to ``parallel`` run at a time, so that the last
        small stages of one leave no cluster idle, and one that fails stops no other.
        """
        chosen = list(dict.fromkeys(keys if keys is not None else self.definitions))
        tables = self._with_shared(chosen) if to_gold else self.tables

        def run(key: str) -> Materialised | None:
            done = None
            if to_gold:
                done = materialise(self.spark, tables, self.layout, key, self.definitions[key])
            if to_cache:
                serving.publish(self.spark, self.layout, key)
            return done

        results, errors = {}, {}
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            jobs = {key: pool.submit(inheritable_thread_target(self.spark)(run), key)
                    for key in chosen}
            for key, job in jobs.items():
                try:
                    results[key] = job.result()
                except Exception as error:
                    errors[key] = error
        if errors:
            raise RefreshError(errors)
        return {key: done for key, done in results.items() if done}

    def _with_shared(self, keys: list[str]):
        stored = {}
        for function, users in self.shared.items():
            if len(users & set(keys)) > 1:
                table = VersionedTable(self.spark, self.layout.shared(function.__name__))
                try:
                    table.replace(function(self.tables))
                except Exception:  # its users compute it themselves and report what fails
                    continue
                stored[function.__name__] = table.read()
        return _WithStored(self.tables, stored) if stored else self.tables

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete results older than the last ``keep`` runs of every key; returns the folders."""
        paths = [self.layout.shared(function.__name__) for function in self.shared]
        paths += [path(key) for key in self.definitions
                  for path in (self.layout.gold, self.layout.cache)]
        return [f"{path}/{folder}" for path in paths
                for folder in VersionedTable(self.spark, path).vacuum(keep)]

    def drop(self, key: str) -> None:
        """Forget a definition and empty what readers see under its key."""
        self.definitions.pop(key, None)
        serving.clear(self.spark, self.layout, key)
