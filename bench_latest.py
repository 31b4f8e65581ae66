"""Time ways to find the latest row per key, on the coded events repeated ``COPIES`` times.

Every copy has admissions of its own, and a third of its events belong to one subject. Prints one
JSON line: the median of three warm runs in seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from medallion.operators import latest_per_key
from medallion.session import local_session, work_folder
from medallion.sources import MedicalTables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "20"))
KEYS, ORDER = ["subject_id"], ["hadm_id", "itemid"]


def one_aggregate(events):
    """Largest struct: one shuffle, sorted within tasks."""
    return latest_per_key(events, KEYS, ORDER)


def two_hash_aggregates(events):
    """Largest item per admission, then that of the largest admission: two shuffles."""
    return (events.groupBy(*KEYS, "hadm_id").agg(F.max("itemid").alias("itemid"))
            .groupBy(*KEYS).agg(F.max("hadm_id"), F.max_by("itemid", "hadm_id")))


def newest_first(events):
    """Largest admission by a hash aggregate, then its items by a join."""
    newest = events.groupBy(*KEYS).agg(F.max("hadm_id").alias("hadm_id"))
    return (events.join(newest, [*KEYS, "hadm_id"], "left_semi")
            .groupBy(*KEYS, "hadm_id").agg(F.max("itemid")))


def main() -> None:
    spark = local_session(CORES, shuffle_partitions=8, app="latest")
    path = work_folder(spark, "latest")
    events = MedicalTables(spark, FOLDER)("drgevents", *KEYS, *ORDER)
    admission, copy = F.col("hadm_id"), F.col("copy")
    events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).select(
        F.when(admission % 3 == 0, 7).otherwise(F.col("subject_id")).alias("subject_id"),
        (admission + copy * 10_000_000).alias("hadm_id"), "itemid").write.parquet(path)
    events = spark.read.parquet(path)
    seconds = {}
    for way in (one_aggregate, two_hash_aggregates, newest_first):
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            way(events).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[way.__name__] = round(statistics.median(runs[1:]), 2)
    print(json.dumps({"rows": events.count(), "seconds": seconds, "cores": CORES}))
    spark.stop()


if __name__ == "__main__":
    main()
