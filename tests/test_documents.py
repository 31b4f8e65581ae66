"""VARIANT documents of mixed shape."""

import json

import pytest
from pyspark.sql import functions as F

from medallion.plans import documents


@pytest.fixture
def mixed(spark, layout):
    numbers = spark.range(24).select(
        (F.col("id") % 12 + 1).cast("int").alias("month"), F.col("id").alias("it's"),
        F.when(F.col("id") > 5, F.lit(1.5)).alias("share"))
    texts = spark.sql("select 'April' as month, 1 as other union all select '4', 2 "
                      "union all select null, 3")
    flags = spark.sql("select true as flag, named_struct('month', 1) as inner")
    documents.publish(spark, layout, "c", [numbers, texts, flags])
    return numbers, documents.read(spark, layout, "c")


def test_documents_keep_their_shapes(mixed):
    found = [json.loads(r[0]) for r in mixed[1].select(F.to_json("document")).collect()]
    assert len(found) == 28
    assert {"flag": True, "inner": {"month": 1}} in found
    assert {"month": "April", "other": 1} in found and {"month": None, "other": 3} in found
    assert {"month": 1, "it's": 0, "share": None} in found


def test_a_filter_passes_values_that_can_be_cast(mixed):
    numbers, docs = mixed
    rows = documents.as_columns(documents.having(docs, "month", [1, 4]), numbers.schema)
    assert rows.schema.simpleString() == numbers.schema.simpleString()
    found = sorted(map(tuple, rows.collect()), key=str)
    assert found == sorted([(1, 0, None), (1, 12, 1.5), (4, 3, None), (4, 15, 1.5),
                            (4, None, None)], key=str)
    assert documents.having(docs, "flag", [True]).count() == 1
    assert documents.having(docs, "share", [1.5]).count() == 18
    assert documents.having(docs, "month", ["April"]).count() == 1
    assert documents.having(docs, "it's", [7]).count() == 1
    assert documents.having(docs, "nowhere", [1]).count() == 0
    assert documents.having(docs, "month", []).count() == 0


def test_filter_and_paths_reach_the_scan(mixed):
    numbers, docs = mixed
    rows = documents.as_columns(documents.having(docs, "month", [1, 4]), numbers.schema)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(document." in plan and "document:variant" not in plan


def test_values_and_names_that_cannot_be_asked_for(mixed):
    for bad in ([1, "1"], [None], [1, True]):
        with pytest.raises(ValueError):
            documents.having(mixed[1], "month", bad)
    with pytest.raises(ValueError):
        documents.having(mixed[1], "\"'", [1])


def test_nothing_published_and_nothing_to_publish(spark, layout, mixed):
    assert documents.read(spark, layout, "never").count() == 0
    documents.publish(spark, layout, "c", [])
    assert documents.read(spark, layout, "c").count() == 0
