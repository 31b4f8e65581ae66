"""Definitions a user writes down: columns, streams, saved queries, and where tables live."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

FIELD_TYPES: dict[str, T.DataType] = {
    "integer": T.IntegerType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    # Beyond the five declared types: ids past 2^31 and measures that must not be rounded.
    "long": T.LongType(),
    "double": T.DoubleType(),
}

ARRIVAL = "Date_Time"
APPEND, MERGE = "APPEND", "MERGE"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    field_type: str
    nullable: bool = True  # advisory: files may hold NULL in any column

    def __post_init__(self):
        if self.field_type not in FIELD_TYPES:
            raise ValueError(f"{self.name}: type {self.field_type!r} is not one of "
                             f"{', '.join(FIELD_TYPES)}")

    def as_field(self) -> T.StructField:
        return T.StructField(self.name, FIELD_TYPES[self.field_type], self.nullable)


def columns(text: str) -> tuple[ColumnSpec, ...]:
    """Columns from ``name type[!], ...``; ``!`` marks a column that should hold no NULL."""
    result = []
    for part in text.split(","):
        name, kind = part.split()
        result.append(ColumnSpec(name, kind.rstrip("!"), not kind.endswith("!")))
    return tuple(result)


@dataclass(frozen=True)
class StreamSpec:
    """One table: where its rows come from and how they enter the silver layer."""

    table: str
    columns: tuple[ColumnSpec, ...]
    method: str = APPEND
    merge_keys: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    # Appended rows lie together by these columns: for lookups by a column with too many values
    # to have a folder each.
    cluster_by: tuple[str, ...] = ()
    # Within one batch the row with the largest values of these columns replaces the others.
    order_by: tuple[str, ...] = ()
    on_duplicate: str = "last"
    source_path: str = ""
    source_format: str = "csv"
    source_options: Mapping[str, str] = field(default_factory=dict)
    payload_format: str = "json"  # of the `value` column of a message source
    # Declared columns that are the message's own (key, topic, offset, ...), not its payload's.
    message_columns: tuple[str, ...] = ()
    bronze_folder: str = "bronze"
    active: bool = True

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.table}: a column is declared twice")
        if any(n.startswith("_") or n == ARRIVAL for n in names):
            raise ValueError(f"{self.table}: {ARRIVAL} and names with a leading _ are reserved")
        if self.method not in (APPEND, MERGE):
            raise ValueError(f"{self.table}: method must be {APPEND} or {MERGE}")
        if self.method == MERGE and not self.merge_keys:
            raise ValueError(f"{self.table}: a merge needs keys")
        if self.bronze_folder in ("silver", "gold", "cache", "checkpoint"):
            raise ValueError(f"{self.table}: {self.bronze_folder} is the name of another layer")
        unknown = {*self.merge_keys, *self.partition_by, *self.order_by, *self.cluster_by,
                   *self.message_columns} - {*names, ARRIVAL}
        if unknown:
            raise ValueError(f"{self.table}: unknown columns {sorted(unknown)}")

    @property
    def source_schema(self) -> T.StructType:
        return T.StructType([c.as_field() for c in self.columns])

    @property
    def table_schema(self) -> T.StructType:
        """Declared columns and the arrival time; nullable, as files give no guarantee."""
        declared = [T.StructField(c.name, FIELD_TYPES[c.field_type]) for c in self.columns]
        return T.StructType([*declared, T.StructField(ARRIVAL, T.TimestampType())])

    @property
    def column_names(self) -> list[str]:
        return [*[c.name for c in self.columns], ARRIVAL]


@dataclass(frozen=True)
class SavedQuery:
    """SQL over the silver tables of a project, stored under a key."""

    key: str
    sql: str


@dataclass(frozen=True)
class Layout:
    """Paths of a project's tables; ``root`` is any URL the cluster can reach."""

    root: str
    project: str

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), self.project, *parts])

    def bronze(self, spec: StreamSpec) -> str:
        return self._path(spec.bronze_folder, spec.table)

    def silver(self, table: str) -> str:
        return self._path("silver", table)

    def gold(self, key: str) -> str:
        return self._path("gold", f"gold_{key}")

    def shared(self, name: str) -> str:
        return self._path("gold", f"shared_{name}")

    def cache(self, key: str) -> str:
        return self._path("cache", f"key={self.project}_{key}")

    def documents(self, collection: str) -> str:
        return self._path("documents", f"collection={self.project}_{collection}")

    def bronze_checkpoint(self, spec: StreamSpec) -> str:
        return self._path("checkpoint", "bronze", spec.bronze_folder, spec.table)

    def silver_checkpoint(self, spec: StreamSpec) -> str:
        return self._path("checkpoint", "silver", spec.table)

    def keyed_checkpoint(self, spec: StreamSpec) -> str:
        return self._path("checkpoint", "keyed", spec.table)

    def refresh_checkpoint(self, key: str) -> str:
        return self._path("checkpoint", "refresh", key)

    def bronze_query(self, spec: StreamSpec) -> str:
        return f"{self.project}-{spec.bronze_folder}-{spec.table}"

    def silver_query(self, spec: StreamSpec) -> str:
        return f"{self.project}-silver-{spec.table}"


def by_table(specs: Sequence[StreamSpec]) -> dict[str, StreamSpec]:
    return {spec.table: spec for spec in specs}
