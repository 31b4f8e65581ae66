from .bronze import read_bronze, start_bronze
from .control import (
    active_queries,
    restart_pipeline,
    run_available,
    start_all,
    start_pipeline,
    stop_all,
    stop_pipeline,
)
from .keyed import read_keyed, start_keyed
from .silver import append_batch, merge_batch, read_silver, start_silver

__all__ = [
    "active_queries", "append_batch", "merge_batch", "read_bronze", "read_keyed",
    "read_silver",
    "restart_pipeline", "run_available", "start_all", "start_bronze", "start_keyed", "start_pipeline",
    "start_silver", "stop_all", "stop_pipeline",
]
