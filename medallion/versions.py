"""A table that is replaced as a whole while others read it.

Its rows lie in a parquet folder that is never changed, ``_version=<number>``. A small JSON file per
replacement, ``_commits/<number>.json``, points to it. Readers follow the newest pointer, so they see
the rows before or after a change, never between, and a writer that dies leaves only a folder that
nothing points to. One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .files import Files


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str | None = None


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = Files(spark)

    @property
    def _commits(self) -> str:
        return f"{self.path}/_commits"

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self._commits) if n.endswith(".json"))

    def commit_at(self, number: int) -> Commit:
        return Commit(**json.loads(self.files.read_text(f"{self._commits}/{number:012d}.json")))

    def current(self) -> Commit:
        numbers = self.numbers()
        return self.commit_at(numbers[-1]) if numbers else Commit(0)

    def commit(self, commit: Commit) -> None:
        text = json.dumps(asdict(commit))
        self.files.create_whole(f"{self._commits}/{commit.number:012d}.json", text)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """The current rows. An empty table needs ``schema``."""
        current = self.current()
        if current.folder is None:
            if schema is None:
                raise FileNotFoundError(f"{self.path} holds no table")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{current.folder}")

    def replace(self, df: DataFrame) -> str:
        """Make ``df`` the whole table; returns its folder."""
        number = self.current().number + 1
        folder = f"_version={number:012d}"
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self.commit(Commit(number, folder))
        return f"{self.path}/{folder}"

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders of all but the last ``keep`` replacements; returns them.

        Call it when no reader may still use an older state and no writer is active.
        """
        if keep < 1:
            raise ValueError("at least the current state must be kept")
        numbers = self.numbers()
        old = [self.commit_at(n) for n in numbers[:-keep]]
        kept = {self.commit_at(n).folder for n in numbers[-keep:]}
        stale = sorted({c.folder for c in old} - kept)
        for folder in stale:
            self.files.delete(f"{self.path}/{folder}")
        for commit in old:
            self.files.delete(f"{self._commits}/{commit.number:012d}.json")
        return stale
