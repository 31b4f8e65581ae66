"""Lookups by Bloom filters and joins of bucketed tables: what is read and what is shuffled."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from medallion import lookups
from medallion.plans import analyses
from medallion.sources import MedicalTables

SCHEMA = "subject bigint, n bigint, text string"


@pytest.fixture
def table(spark, tmp_path):
    """Subjects 0, 7, 14, ... in no order, in one file with many row groups."""
    path = str(tmp_path / "t")
    df = spark.range(60_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(3000)) * 7).alias("subject"), F.col("id").alias("n"),
        F.repeat(F.md5(F.col("id").cast("string")), F.lit(4)).alias("text")).coalesce(1)
    lookups.write_lookup(df, path, ["subject"], different=3000, row_group_bytes=200_000)
    return path


def _wanted(spark, values):
    return spark.createDataFrame([(v, "x") for v in values], "subject bigint, other string")


def _scanned(df):
    """Rows that the scan of files gave to the plan when ``df`` was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value()
               for i in range(leaves.size()) if "Scan parquet" in leaves.apply(i).nodeName())


def test_row_groups_without_the_values_are_skipped(spark, table):
    assert _scanned(spark.read.schema(SCHEMA).parquet(table)) == 60_000
    # 5 lies within every row group's range, but no subject has it.
    nothing = lookups.rows_of(spark, table, SCHEMA, "subject", _wanted(spark, [5, 11, None]))
    assert nothing.count() == 0 and _scanned(nothing) < 12_000


def test_few_and_many_values_find_the_same_rows(spark, table):
    values = [7 * i for i in range(40)] + [7, 7, None, 3]
    expected = rows(spark.read.schema(SCHEMA).parquet(table).filter(
        F.col("subject").isin([v for v in values if v is not None])))
    assert len(expected) > 300
    listed = lookups.rows_of(spark, table, SCHEMA, "subject", _wanted(spark, values))
    joined = lookups.rows_of(spark, table, SCHEMA, "subject", _wanted(spark, values), most_listed=5)
    assert rows(listed) == rows(joined) == expected
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()
    assert lookups.rows_of(spark, table, SCHEMA, "subject", _wanted(spark, [])).count() == 0


def test_bucketed_facts_are_joined_without_an_exchange(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    tables = MedicalTables(spark, folder)
    buckets = {"admissions": "test_admissions", "drgevents": "test_drgevents"}
    names = {"admissions": ["hadm_id", "admit_dt", "disch_dt"], "drgevents": ["hadm_id", "itemid"]}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, table in buckets.items():
            lookups.write_buckets(tables(name, *names[name]), table, str(tmp_path / name),
                                  ["hadm_id"], 4)
        over = analyses._cases(lookups.BucketedTables(spark, tables, buckets))
        plain = analyses._cases(tables)
        assert "Exchange hashpartitioning(hadm_id" in plain._jdf.queryExecution().toString()
        plan = over._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(over) == rows(plain)
        whole = lookups.BucketedTables(spark, tables, buckets)("admissions")
        assert whole.columns == tables("admissions").columns  # the buckets hold some columns only
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for table in buckets.values():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
