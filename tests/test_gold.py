"""Saved queries and analyses to gold, and the documents readers get."""

import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from medallion.plans import gold, serving
from medallion.presets import hospital_streams
from medallion.spec import ARRIVAL, SavedQuery
from medallion.streaming.silver import append_batch, merge_batch
from medallion.versions import VersionedTable


@pytest.fixture
def tables(spark, layout):
    """Silver tables of a project, written batch-wise from the preset definitions."""
    specs = {s.table: s for s in hospital_streams("unused")}
    data = {
        "d_patients": [(1, "F", None, None, "Y"), (2, None, None, None, "N")],
        "admissions": [(10, 1, datetime(2005, 3, 1), datetime(2005, 3, 4)),
                       (20, 2, datetime(2006, 3, 1), datetime(2006, 3, 2))],
        "icustayevents": [(1, 1, None, None, 4, 5, 6)],
    }
    for name, values in data.items():
        spec = specs[name]
        batch = spark.createDataFrame(values, spec.source_schema).withColumn(
            ARRIVAL, F.current_timestamp())
        (merge_batch if spec.method == "MERGE" else append_batch)(batch, spec, layout, "q", 0)
    return gold.SilverTables(spark, layout, [specs[n] for n in data])


def test_saved_query_over_silver(spark, layout, tables):
    query = SavedQuery("stay", """select sex, extract(day from disch_dt - admit_dt) as days
        from admissions
        join d_patients on d_patients.subject_id = admissions.subject_id""")
    done = gold.materialise(spark, tables, layout, query.key, query)
    assert rows(spark.sql(f"select sex, days from parquet.`{done.path}`")) == [(None, 1), ("F", 3)]
    assert done.seconds > 0
    # Another result under the key, with another schema.
    other = SavedQuery("stay", "select count(*) n from icustayevents")
    gold.materialise(spark, tables, layout, "stay", other)
    assert rows(gold.read_gold(spark, layout, "stay")) == [(1,)]


def test_a_failed_run_leaves_the_old_result(spark, layout, tables):
    good = SavedQuery("k", "select subject_id from d_patients")
    bad = SavedQuery("k", "select raise_error('no') as subject_id from d_patients")
    gold.materialise(spark, tables, layout, "k", good)
    with pytest.raises(Exception):
        gold.materialise(spark, tables, layout, "k", bad)
    assert rows(gold.read_gold(spark, layout, "k")) == [(1,), (2,)]


def test_adhoc_sql_takes_values_apart_from_its_text(spark, tables):
    df = gold.run_sql(spark, tables, "select hadm_id from admissions where subject_id = :s", {"s": 2})
    assert rows(df) == [(20,)]
    evil = "0 or 1 = 1"
    df = gold.run_sql(spark, tables, "select sex from d_patients where sex = :s", {"s": evil})
    assert rows(df) == []


def test_only_named_tables_become_views(spark, tables):
    asked = []

    class Watched:
        names = staticmethod(tables.names)

        def on(self, session):
            self.inner = tables.on(session)
            return self

        def __call__(self, name, *columns):
            asked.append(name)
            return self.inner(name, *columns)

    df = gold.run_sql(spark, Watched(), "SELECT count(*) FROM Admissions\nWHERE hadm_id > 0")
    assert rows(df) == [(2,)] and asked == ["admissions"]


def test_a_statement_leaves_the_callers_views_alone(spark, tables):
    spark.range(3).createOrReplaceTempView("d_patients")
    try:
        assert gold.run_sql(spark, tables, "select sex from d_patients").count() == 2
        gold.describe(spark, tables, "d_patients")
        assert spark.table("d_patients").columns == ["id"]
    finally:
        spark.catalog.dropTempView("d_patients")


def test_projects_that_run_at_once_read_their_own_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from medallion.sources import MedicalTables

    folders = [f"/root/testdata/{sf}" for sf in ("sf0.001", "sf0.01")]
    sql = "select count(*) from d_patients"

    def counts(folder):
        return {gold.run_sql(spark, MedicalTables(spark, folder), sql).first()[0]
                for _ in range(25)}

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(counts, folders * 2))
    assert found == [{150}, {1500}] * 2


def test_describe(spark, tables):
    assert [tuple(r) for r in gold.describe(spark, tables, "d_patients").collect()] == [
        ("subject_id", "int", None), ("sex", "string", None), ("dob", "timestamp", None),
        ("dod", "timestamp", None), ("hospital_expire_flg", "string", None),
        (ARRIVAL, "timestamp", None)]


def test_publish_replaces_one_key_only(spark, layout, tables):
    registry = gold.Registry(spark, tables, layout)
    registry.register_and_run(SavedQuery("a", "select subject_id, sex from d_patients"))
    registry.register_and_run(SavedQuery("b", "select 1 as one"))
    documents = [json.loads(r.row) for r in serving.read(spark, layout, "a").collect()]
    assert sorted(documents, key=lambda d: d["subject_id"]) == [
        {"subject_id": 1, "sex": "F"}, {"subject_id": 2}]
    # The registry uses the current text of a query; an empty result empties its key.
    registry.save(SavedQuery("a", "select subject_id, sex from d_patients where subject_id > 5"))
    registry.refresh(["a"])
    assert serving.read(spark, layout, "a").count() == 0
    assert rows(serving.read(spark, layout, "b")) == [('{"one":1}',)]
    assert serving.read(spark, layout, "never").count() == 0
    registry.drop("b")
    assert serving.read(spark, layout, "b").count() == 0 and "b" not in registry.definitions


def test_refresh_all_and_gold_only(spark, layout, tables):
    registry = gold.Registry(spark, tables, layout, {
        "x": lambda t: t("d_patients", "subject_id"), "y": SavedQuery("y", "select 2 as two")})
    assert set(registry.refresh(to_cache=False)) == {"x", "y"}
    assert serving.read(spark, layout, "x").count() == 0
    registry.refresh(to_gold=False)
    assert serving.read(spark, layout, "x").count() == 2


def test_rows_of_months(spark, layout, tables):
    query = SavedQuery("m", "select explode(sequence(1, 12)) as month, 'v' as v")
    gold.Registry(spark, tables, layout).register_and_run(query)
    by_gold = serving.read_rows(spark, layout, "m")
    assert rows(serving.rows_of_months(by_gold, [3, 5])) == [(3, "v"), (5, "v")]
    typed = serving.read_rows(spark, layout, "m", "month bigint, missing string")
    assert rows(serving.rows_of_months(typed, [3])) == [(3, None)]
    assert serving.rows_of_months(by_gold, []).count() == 0


def test_readers_keep_their_state_while_a_table_is_replaced(spark, layout):
    table = VersionedTable(spark, layout.gold("z"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(3).toDF("a"))
    held = table.read()
    table.replace(spark.range(5).toDF("b"))
    assert held.count() == 3 and table.read().columns == ["b"]
    assert table.vacuum(keep=1) == ["_version=000000000001"]
    assert table.read().count() == 5


def test_two_writers_cannot_make_the_same_commit(spark, layout):
    table = VersionedTable(spark, layout.gold("z"))
    table.replace(spark.range(1))
    with pytest.raises(FileExistsError):
        table.commit(table.current())


def test_a_refresh_joins_the_facts_once_for_several_analyses(spark, layout):
    from medallion.plans import analyses
    from medallion.sources import MedicalTables

    asked = []

    class Watched(MedicalTables):
        def __call__(self, name, *columns):
            asked.append(name)
            return super().__call__(name, *columns)

    tables = Watched(spark, "/root/testdata/sf0.001")
    keys = analyses.SHARED[analyses.item_months]
    registry = gold.Registry(spark, tables, layout, analyses.GOLD_ANALYSES, analyses.SHARED)
    registry.refresh(keys, to_cache=False)
    assert asked.count("drgevents") == 1
    for key in keys:
        alone = analyses.GOLD_ANALYSES[key](MedicalTables(spark, "/root/testdata/sf0.001"))
        assert rows(gold.read_gold(spark, layout, key)) == rows(alone)
    asked.clear()
    registry.refresh(keys[:1], to_cache=False)
    assert asked.count("drgevents") == 1


def test_answer_holds_documents_and_time(spark, tables):
    result = gold.answer(spark, tables, "select hadm_id, subject_id from admissions where hadm_id = :h",
                         {"h": 10})
    assert rows(result.rows) == [('{"hadm_id":10,"subject_id":1}',)] and result.seconds > 0
    result.discard()
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(result.path)
    nothing = gold.answer(spark, tables, "select hadm_id from admissions where hadm_id < 0")
    assert rows(nothing.rows) == []


def test_vacuum_keeps_the_last_runs(spark, layout, tables):
    registry = gold.Registry(spark, tables, layout, {"n": SavedQuery("n", "select 1 as n")})
    for _ in range(4):
        registry.refresh()
    stale = registry.vacuum()
    assert len(stale) == 4 and all("_version=00000000000" in path for path in stale)
    assert registry.vacuum() == []
    assert rows(serving.read(spark, layout, "n")) == [('{"n":1}',)]


def test_one_failing_key_stops_no_other(spark, layout, tables):
    registry = gold.Registry(spark, tables, layout, {
        "bad": SavedQuery("bad", "select no_such_column from d_patients"),
        "good": SavedQuery("good", "select count(*) as n from d_patients"),
        "late": SavedQuery("late", "select raise_error('no') as x")})
    with pytest.raises(gold.RefreshError) as caught:
        registry.refresh()
    assert set(caught.value.errors) == {"bad", "late"}
    assert rows(serving.read(spark, layout, "good")) == [('{"n":2}',)]
    with pytest.raises(gold.RefreshError):
        registry.refresh(["unknown"])


def test_a_failing_shared_step_stops_only_its_users(spark, layout):
    from medallion.plans import analyses
    from medallion.sources import MedicalTables

    class Broken(MedicalTables):
        def __call__(self, name, *columns):
            if name == "admissions":
                raise OSError("unreadable")
            return super().__call__(name, *columns)

    registry = gold.Registry(spark, Broken(spark, "/root/testdata/sf0.001"), layout,
                             analyses.GOLD_ANALYSES, analyses.SHARED)
    users = analyses.SHARED[analyses.item_months]
    with pytest.raises(gold.RefreshError) as caught:
        registry.refresh([*users, "patients_by_sex", "patients_by_sex"])
    assert set(caught.value.errors) == set(users)
    assert serving.read(spark, layout, "patients_by_sex").count() == 3
