"""Starting, stopping and listing the pairs of queries behind the tables of a project."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..spec import Layout, StreamSpec
from .bronze import start_bronze
from .silver import start_silver

AVAILABLE_NOW = {"availableNow": True}


def start_pipeline(spark: SparkSession, spec: StreamSpec, layout: Layout,
                   trigger: dict | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """Start source -> bronze and bronze -> silver; by default as fast as batches finish."""
    return (start_bronze(spark, spec, layout, trigger), start_silver(spark, spec, layout, trigger))


def run_available(spark: SparkSession, spec: StreamSpec, layout: Layout) -> None:
    """Carry everything that has arrived so far into silver, then return."""
    for start in (start_bronze, start_silver):
        start(spark, spec, layout, AVAILABLE_NOW).awaitTermination()


def _is_active(spark: SparkSession, names: set[str]) -> list[StreamingQuery]:
    return [q for q in spark.streams.active if q.name in names]


def stop_pipeline(spark: SparkSession, spec: StreamSpec, layout: Layout) -> list[str]:
    """Stop both queries of a table; returns the names of those that were active."""
    names = {layout.bronze_query(spec), layout.silver_query(spec)}
    stopped = []
    for query in _is_active(spark, names):
        query.stop()
        stopped.append(query.name)
    return stopped


def active_queries(spark: SparkSession) -> list[dict]:
    return [
        {"id": str(q.id), "name": q.name, "status": q.status["message"]}
        for q in spark.streams.active
    ]


def start_all(spark: SparkSession, specs: Iterable[StreamSpec], layout: Layout,
              trigger: dict | None = None) -> list[str]:
    """Start the active streams of a project that do not run yet."""
    started = []
    for spec in specs:
        names = {layout.bronze_query(spec), layout.silver_query(spec)}
        if spec.active and not _is_active(spark, names):
            start_pipeline(spark, spec, layout, trigger)
            started.append(spec.table)
    return started


def stop_all(spark: SparkSession, specs: Iterable[StreamSpec], layout: Layout) -> list[str]:
    return [name for spec in specs for name in stop_pipeline(spark, spec, layout)]


def restart_pipeline(spark: SparkSession, old: StreamSpec, new: StreamSpec, layout: Layout,
                     trigger: dict | None = None) -> None:
    """Put a changed definition into effect; checkpoints keep the position."""
    stop_pipeline(spark, old, layout)
    if new.active:
        start_pipeline(spark, new, layout, trigger)
