"""Files -> bronze -> silver, in arrivals, after restarts and replays."""

import os
import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from medallion.sources import decode_payload, read_csv
from medallion.spec import ARRIVAL, MERGE, StreamSpec, columns
from medallion.streaming import (
    active_queries,
    append_batch,
    merge_batch,
    read_bronze,
    read_silver,
    restart_pipeline,
    run_available,
    start_all,
    start_bronze,
    start_pipeline,
    stop_all,
    stop_pipeline,
)
from medallion.streaming.control import AVAILABLE_NOW

T0 = datetime(2024, 1, 1, 12, 0, 0, 123456)
COLUMNS = columns("id integer!, at timestamp, kind string, x float, ok boolean")


def _spec(tmp_path, **settings):
    settings = {"source_path": str(tmp_path / "in"), **settings}
    return StreamSpec("t", COLUMNS, **settings)


def _merge_spec(tmp_path, **settings):
    return _spec(tmp_path, **{"method": MERGE, "merge_keys": ("id",), "order_by": ("at",),
                              **settings})


def _deliver(tmp_path, name, lines):
    (tmp_path / "in").mkdir(exist_ok=True)
    text = "\n".join(["id,at,kind,x,ok", *lines]) + "\n"
    (tmp_path / "in" / f"{name}.csv").write_text(text)


def _line(i, minutes, kind="k", x=1.5, ok="true"):
    return f"{i},{(T0 + timedelta(minutes=minutes)).isoformat()},{kind},{x},{ok}"


def _batch(spark, spec, data):
    """Rows (id, minutes, kind) as a batch of bronze rows."""
    df = spark.createDataFrame(
        [(i, T0 + timedelta(minutes=m), k, 1.5, True) for i, m, k in data],
        spec.source_schema.simpleString()[7:-1])
    return df.withColumn(ARRIVAL, F.current_timestamp())


def _kinds(spark, spec, layout):
    return rows(read_silver(spark, spec, layout).select("id", "kind"))


def test_bad_cells_become_null_and_no_row_is_lost(spark, layout, tmp_path):
    spec = _spec(tmp_path)
    _deliver(tmp_path, "a", [_line(1, 0), ",not a time,k,y,perhaps", "x1,2024-01-01,k,1,false"])
    start_bronze(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
    result = rows(read_bronze(spark, spec, layout).drop(ARRIVAL))
    assert result == [
        (None, None, "k", None, None), (None, datetime(2024, 1, 1), "k", 1.0, False),
        (1, T0, "k", 1.5, True)]
    assert read_bronze(spark, spec, layout).filter(F.col(ARRIVAL).isNull()).count() == 0
    assert read_csv(spark, spec.source_path, spec.source_schema).count() == 3


def test_tables_are_readable_ahead_of_any_batch(spark, layout, tmp_path):
    (tmp_path / "in").mkdir()
    for spec in (_spec(tmp_path), _merge_spec(tmp_path)):
        run_available(spark, spec, layout)
        df = read_silver(spark, spec, layout)
        assert df.columns == ["id", "at", "kind", "x", "ok", ARRIVAL] and df.count() == 0
        assert read_bronze(spark, spec, layout).count() == 0


@pytest.mark.parametrize("partition_by", [(), ("kind",)])
def test_append_equals_input_over_restarts(spark, layout, tmp_path, partition_by):
    spec = _spec(tmp_path, partition_by=partition_by)
    for k in range(3):
        _deliver(tmp_path, f"f{k}", [_line(10 * k + i, i, f"kind{i % 2}") for i in range(5)])
        run_available(spark, spec, layout)
    run_available(spark, spec, layout)  # nothing new
    silver = read_silver(spark, spec, layout)
    assert rows(silver.select("id")) == [(10 * k + i,) for k in range(3) for i in range(5)]
    assert rows(silver) == rows(read_bronze(spark, spec, layout))


@pytest.mark.parametrize("cuts", [1, 2, 4])
def test_merge_holds_the_newest_row_for_any_number_of_arrivals(spark, layout, tmp_path, cuts):
    spec = _merge_spec(tmp_path)
    lines = [_line(i % 7, i, f"k{i}") for i in range(28)]
    size = len(lines) // cuts
    for k in range(cuts):
        _deliver(tmp_path, f"f{k}", lines[k * size:(k + 1) * size])
        run_available(spark, spec, layout)
    assert _kinds(spark, spec, layout) == [(i, f"k{21 + i}") for i in range(7)]


def test_a_late_file_is_not_skipped(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    _deliver(tmp_path, "a", [_line(1, 0)])
    run_available(spark, spec, layout)
    _deliver(tmp_path, "b", [_line(2, 0)])
    month_ago = time.time() - 30 * 86_400
    os.utime(tmp_path / "in" / "b.csv", (month_ago, month_ago))
    run_available(spark, spec, layout)
    assert [i for i, _ in _kinds(spark, spec, layout)] == [1, 2]


def test_between_batches_the_last_one_wins(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    for minutes in (30, 20, 10):
        _deliver(tmp_path, f"f{minutes}", [_line(1, minutes, f"k{minutes}")])
        run_available(spark, spec, layout)
    assert _kinds(spark, spec, layout) == [(1, "k10")]


def test_replayed_batches_change_nothing(spark, layout, tmp_path):
    merge, append = _merge_spec(tmp_path), _spec(tmp_path)
    for number, data in enumerate([[(1, 0, "a"), (2, 0, "a")], [(1, 1, "b")]]):
        merge_batch(_batch(spark, merge, data), merge, layout, "q", number)
    assert _kinds(spark, merge, layout) == [(1, "b"), (2, "a")]
    merge_batch(_batch(spark, merge, [(1, 0, "a")]), merge, layout, "q", 0)
    assert _kinds(spark, merge, layout) == [(1, "b"), (2, "a")]
    # A new checkpoint counts from 0 again under another id; its batch is not a replay.
    merge_batch(_batch(spark, merge, [(1, 0, "c")]), merge, layout, "other", 0)
    assert _kinds(spark, merge, layout) == [(1, "c"), (2, "a")]

    other = StreamSpec("u", append.columns)
    for _ in range(2):
        append_batch(_batch(spark, other, [(1, 0, "a"), (1, 0, "a")]), other, layout, "q", 0)
    append_batch(_batch(spark, other, [(1, 0, "a")]), other, layout, "new", 0)
    assert read_silver(spark, other, layout).count() == 3


def test_a_batch_that_died_is_written_again(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    merge_batch(_batch(spark, spec, [(1, 0, "a")]), spec, layout, "q", 0)

    dying = _batch(spark, spec, [(1, 1, "b"), (2, 1, "b")]).withColumn(
        "kind", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="lost"):
        merge_batch(dying, spec, layout, "q", 1)
    assert _kinds(spark, spec, layout) == [(1, "a")]
    merge_batch(_batch(spark, spec, [(1, 1, "b"), (2, 1, "b")]), spec, layout, "q", 1)
    assert _kinds(spark, spec, layout) == [(1, "b"), (2, "b")]


def test_a_batch_writes_only_its_rows(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    merge_batch(_batch(spark, spec, [(i, 0, "a") for i in range(200)]), spec, layout, "q", 0)
    table = tmp_path / "medical" / "silver" / "t" / "_stream=000000-q"
    before = {p: p.stat().st_mtime_ns for p in (table / "_batch=0").iterdir()}
    merge_batch(_batch(spark, spec, [(5, 1, "b"), (200, 1, "b")]), spec, layout, "q", 1)
    assert before == {p: p.stat().st_mtime_ns for p in (table / "_batch=0").iterdir()}
    assert {p.name for p in table.iterdir()} == {"_batch=0", "_batch=1"}
    assert spark.read.parquet(str(table / "_batch=1")).count() == 2
    assert read_silver(spark, spec, layout).count() == 201


def test_many_batches_of_two_streams(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    for number in range(12):
        merge_batch(_batch(spark, spec, [(number % 4, 0, "a"), (0, number, f"k{number}"),
                                         (None, number, "n")]), spec, layout, "q", number)
    expected = [(None, "n")] * 12 + [(0, "k11"), (1, "a"), (2, "a"), (3, "a")]
    assert _kinds(spark, spec, layout) == expected
    merge_batch(_batch(spark, spec, [(9, 0, "replay")]), spec, layout, "q", 3)
    merge_batch(_batch(spark, spec, [(1, 5, "z"), (None, 9, "n")]), spec, layout, "a-b", 0)
    merge_batch(_batch(spark, spec, [(9, 0, "replay")]), spec, layout, "a-b", 0)
    expected = [(None, "n")] * 13 + [(0, "k11"), (1, "z"), (2, "a"), (3, "a")]
    assert _kinds(spark, spec, layout) == expected


def test_appended_tables_are_read_by_folder(spark, layout, tmp_path):
    spec = _spec(tmp_path, partition_by=("kind",))
    for number in range(2):
        append_batch(_batch(spark, spec, [(i, number, k) for i, k in enumerate(
            ["a", "b", "", None, "c/d"])]), spec, layout, "q", number)
    df = read_silver(spark, spec, layout)
    assert df.schema == spec.table_schema
    assert rows(df.select("kind").distinct()) == [(None,), ("",), ("a",), ("b",), ("c/d",)]
    one = df.filter("kind = 'b'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "_by_kind" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(one.inputFiles()) == 10 and rows(one.select("id")) == [(1,), (1,)]
    read = {r[0] for r in one.select(F.col("_metadata.file_path")).collect()}
    assert len(read) == 2 and all("_by_kind=_b" in path for path in read)


@pytest.mark.parametrize("keys", [("id",), ("id", "kind")])
def test_empty_partition_values_lose_no_row(spark, layout, tmp_path, keys):
    spec = _merge_spec(tmp_path, partition_by=("kind",), merge_keys=keys)
    data = [(i, 0, "") for i in range(24)] + [(None, i, "") for i in range(24)]
    merge_batch(_batch(spark, spec, data), spec, layout, "q", 0)
    for number in range(8):
        merge_batch(_batch(spark, spec, [(number, 1, "")]), spec, layout, "q", number + 1)
        assert read_silver(spark, spec, layout).count() == 48
    assert read_silver(spark, spec, layout).filter("kind = ''").count() == 48


def test_clustered_files_hold_ranges(spark, layout, tmp_path):
    spec = StreamSpec("c", COLUMNS, cluster_by=("id",))
    data = [(i % 50, i, "hot" if i % 3 else "k") for i in range(400)] + [(7, i, "x") for i in range(200)]
    # Ranges this small would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        append_batch(_batch(spark, spec, data).repartition(4), spec, layout, "q", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    df = read_silver(spark, spec, layout)
    assert df.count() == 600
    ranges = rows(df.groupBy(F.col("_metadata.file_path")).agg(F.min("id"), F.max("id"), F.count("*")))
    assert len(ranges) > 1
    bounds = sorted((low, high) for _, low, high, _ in ranges)
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    assert max(n for *_, n in ranges) < 300  # the hot value 7 is not in one file


def test_a_key_may_move_to_another_partition(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path, partition_by=("kind",))
    merge_batch(_batch(spark, spec, [(1, 0, "a"), (2, 0, "a"), (3, 0, None)]), spec, layout, "q", 0)
    merge_batch(_batch(spark, spec, [(1, 1, "b"), (4, 1, "c d=/")]), spec, layout, "q", 1)
    assert _kinds(spark, spec, layout) == [(1, "b"), (2, "a"), (3, None), (4, "c d=/")]


def test_null_keys_are_added_and_spread(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    data = [(None, m, "n") for m in range(100)]
    merge_batch(_batch(spark, spec, data), spec, layout, "q", 0)
    merge_batch(_batch(spark, spec, [(None, 0, "n"), (1, 0, "a")]), spec, layout, "q", 1)
    assert read_silver(spark, spec, layout).count() == 102


def test_an_empty_batch_changes_nothing(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    for number in range(4):
        merge_batch(_batch(spark, spec, [(i, number, f"k{number}") for i in range(20)]),
                    spec, layout, "q", number)
    merge_batch(_batch(spark, spec, [(1, 0, "x")]).limit(0), spec, layout, "q", 4)
    expected = [(i, "k3") for i in range(20)]
    assert _kinds(spark, spec, layout) == expected
    merge_batch(_batch(spark, spec, [(0, 9, "z")]), spec, layout, "q", 5)
    assert _kinds(spark, spec, layout) == [(0, "z"), *expected[1:]]


def test_merge_is_idempotent_and_disjoint_keys_unite(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path)
    batch = [(i, 0, "a") for i in range(10)]
    for number in range(2):
        merge_batch(_batch(spark, spec, batch), spec, layout, "q", number)
    assert _kinds(spark, spec, layout) == [(i, "a") for i in range(10)]
    merge_batch(_batch(spark, spec, [(i, 0, "b") for i in range(10, 15)]), spec, layout, "q", 2)
    assert len(_kinds(spark, spec, layout)) == 15


def test_duplicates_can_be_an_error(spark, layout, tmp_path):
    spec = _merge_spec(tmp_path, on_duplicate="error")
    with pytest.raises(ValueError, match="several rows"):
        merge_batch(_batch(spark, spec, [(1, 0, "a"), (1, 1, "b")]), spec, layout, "q", 0)
    assert read_silver(spark, spec, layout).count() == 0


def test_messages_are_decoded(spark, layout, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_text('{"id": 1, "kind": "a", "x": 2.5}\nnot json\n')
    spec = _spec(tmp_path, source_format="text")
    start_bronze(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
    result = rows(read_bronze(spark, spec, layout).select("id", "kind", "x", "ok"))
    assert result == [(None, None, None, None), (1, "a", 2.5, None)]
    csv = spark.createDataFrame([(bytearray(b"7,b"), "t1"), (None, "t2")], "value binary, topic string")
    decoded = decode_payload(csv, "id int, kind string", payload_format="csv")
    assert rows(decoded) == [("t1", 7, "b"), ("t2", None, None)]
    with pytest.raises(ValueError):
        decode_payload(csv, "id int", payload_format="avro")


def test_start_list_stop_restart(spark, layout, tmp_path):
    (tmp_path / "in").mkdir()
    spec = _spec(tmp_path)
    idle = StreamSpec("idle", COLUMNS, source_path=str(tmp_path / "in"), active=False)
    trigger = {"processingTime": "200 milliseconds"}
    names = {layout.bronze_query(spec), layout.silver_query(spec)}
    try:
        start_pipeline(spark, spec, layout, trigger)
        assert {q["name"] for q in active_queries(spark)} == names
        assert start_all(spark, [spec, idle], layout, trigger) == []
        restart_pipeline(spark, spec, spec, layout, trigger)
        _deliver(tmp_path, "f", [_line(1, 0)])
        for name in (layout.bronze_query(spec), layout.silver_query(spec)):
            next(q for q in spark.streams.active if q.name == name).processAllAvailable()
        assert read_silver(spark, spec, layout).count() == 1
        assert set(stop_pipeline(spark, spec, layout)) == names
        assert stop_pipeline(spark, spec, layout) == []
        assert start_all(spark, [spec, idle], layout, trigger) == ["t"]
    finally:
        stop_all(spark, [spec, idle], layout)
    assert active_queries(spark) == []
    assert read_silver(spark, spec, layout).count() == 1


def test_columns_of_a_message_are_taken_along(spark):
    from medallion.sources import stream_source

    spec = StreamSpec("m", columns("timestamp timestamp, k long"), source_format="rate",
                      message_columns=("timestamp",))
    messages = stream_source(spark, spec)
    assert messages.isStreaming and messages.dtypes == [("timestamp", "timestamp"), ("k", "bigint")]
    plain = StreamSpec("m", columns("k long, s string"), source_format="rate")
    assert stream_source(spark, plain).columns == ["k", "s"]
    with pytest.raises(ValueError):
        StreamSpec("m", columns("k long"), message_columns=("offset",))
