import pytest

from medallion.presets import hospital_streams
from medallion.session import work_folder
from medallion.spec import ColumnSpec, Layout, StreamSpec, columns


def test_columns_from_text():
    parsed = columns("id integer!, at timestamp, name string")
    assert parsed == (ColumnSpec("id", "integer", False), ColumnSpec("at", "timestamp"),
                      ColumnSpec("name", "string"))


@pytest.mark.parametrize("make", [
    lambda: columns("id decimal"),
    lambda: StreamSpec("t", columns("id integer, id string")),
    lambda: StreamSpec("t", columns("_version integer")),
    lambda: StreamSpec("t", columns("id integer"), method="MERGE"),
    lambda: StreamSpec("t", columns("id integer"), method="DELETE"),
    lambda: StreamSpec("t", columns("id integer"), partition_by=("x",)),
    lambda: StreamSpec("t", columns("id integer"), bronze_folder="silver"),
])
def test_bad_definitions_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_schemas():
    spec = StreamSpec("t", columns("id integer!, x float"))
    assert spec.source_schema.simpleString() == "struct<id:int,x:float>"
    assert not spec.source_schema["id"].nullable
    assert spec.table_schema.simpleString() == "struct<id:int,x:float,Date_Time:timestamp>"
    assert spec.table_schema["id"].nullable


def test_layers_do_not_share_paths():
    layout, spec = Layout("s3a://lake/", "medical"), StreamSpec("t", columns("id integer"))
    paths = [layout.bronze(spec), layout.silver("t"), layout.gold("t"), layout.cache("t"),
             layout.bronze_checkpoint(spec), layout.silver_checkpoint(spec)]
    assert len(set(paths)) == 6
    assert layout.bronze(spec) == "s3a://lake/medical/bronze/t"
    assert layout.gold("k") == "s3a://lake/medical/gold/gold_k"


def test_the_thirteen_tables():
    specs = {s.table: s for s in hospital_streams("hdfs:///incoming/")}
    assert {n: len(s.columns) for n, s in specs.items()} == {
        "d_patients": 5, "admissions": 4, "drgevents": 4, "d_codeditems": 6,
        "demographic_detail": 14, "icd9": 5, "icustay_days": 7, "icustay_detail": 42,
        "chartevents": 16, "icustayevents": 7, "ioevents": 16, "labevents": 9, "medevents": 16}
    assert {n for n, s in specs.items() if s.method == "APPEND"} == {
        "chartevents", "icustayevents", "ioevents", "labevents", "medevents"}
    assert specs["icustay_days"].merge_keys == ("icustay_id", "seq")
    assert specs["icd9"].source_path == "hdfs:///incoming/icd9"


def test_work_folder_follows_the_session(spark, tmp_path):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf(conf)

    shared = Session(**{"spark.checkpoint.dir": "hdfs:///shared/", "spark.master": "yarn"})
    assert work_folder(shared, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        work_folder(Session(**{"spark.master": "yarn"}), "x")
    assert work_folder(spark, "x") != work_folder(spark, "x")
