"""Session settings and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the library relies on. All of them may be set on a live session.
RUNTIME_CONF = {
    # Timestamps are wall-clock UTC everywhere, so year() and month() do not depend on the host.
    "spark.sql.session.timeZone": "UTC",
    # Joins of two fact tables rely on AQE to split a key that holds much of the data,
    # to coalesce small shuffle partitions and to turn a join into a broadcast only
    # after the size of the side has been measured.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Persisted batches and training rows are coalesced like any other result.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Give ``spark`` the settings above, for good: the caller's session is the one that runs."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def apart(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and views of its own, on the same cluster."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            child.conf.set(key, value)
    return child


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "medallion", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster build the session as usual and call :func:`apply_runtime_conf` on it.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Recording a call site for every Column costs milliseconds per call.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime_conf(spark)


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """Goes when the process ends."""
    return tempfile.TemporaryDirectory(prefix="medallion-", ignore_cleanup_errors=True)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    Only a session on one machine may go without that setting; it then gets a
    temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_folder().name
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
