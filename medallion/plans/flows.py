"""The operators around the analyses, each run end to end over whole tables of a folder.

A query that writes tables does so in a new folder below ``spark.checkpoint.dir`` and returns
a DataFrame over what it wrote.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classifier, curve, keep_newest, latest_per_key, top_k, upsert
from ..operators.sampling import oversample, split_by_class, undersample
from ..session import work_folder
from .. import lookups, partitions
from ..sources import MedicalTables, decode_payload, message_log, read_csv
from ..sources.medical import read_file
from ..spec import ARRIVAL, MERGE, Layout, SavedQuery, StreamSpec, columns
from ..streaming import (read_bronze, read_keyed, read_silver, run_available, start_bronze,
                         start_keyed)
from ..streaming.control import AVAILABLE_NOW
from . import analyses, documents, gold, incremental, serving

FIRST_YEAR, LAST_YEAR = 1996, 2000
MONTHS = [1, 4, 12]
SUBSET = ["admissions_deaths_by_year", "admission_state_mortality", "hospital_death_ratio"]
ARRIVALS = 3
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # keeps microseconds in CSV
REPLACED_TYPE, TYPES = "STANDARD", ["STANDARD", "PROMO", ""]
OFTEN = 50  # subjects looked up at once
BUCKETS = 16
EVENT_COLUMNS = "event_id long!, ts timestamp, user_id long!, event_type string, value double"


def _layout(spark: SparkSession, purpose: str) -> Layout:
    return Layout(work_folder(spark, purpose), "medical")


def upsert_batch(spark: SparkSession, folder: str) -> DataFrame:
    """When each subject was last seen: chart events as the table, admissions as the batch."""
    tables = MedicalTables(spark, folder)
    seen = latest_per_key(
        tables("chartevents", "subject_id", "charttime").withColumnRenamed("charttime", "seen")
        .withColumn("source", F.lit("chart")), ["subject_id"], ["seen"])
    batch = (
        tables("admissions", "subject_id", "admit_dt").withColumnRenamed("admit_dt", "seen")
        .withColumn("source", F.lit("admission"))
    )
    return upsert(seen, keep_newest(batch, ["subject_id"], ["seen"]), ["subject_id"])


def saved_query_gold(spark: SparkSession, folder: str) -> DataFrame:
    """A saved join of four tables under bare names, materialised and read back."""
    layout = _layout(spark, "saved-query")
    query = SavedQuery("types_by_sex", """
        select sex, type, count(*) as num, max(cost_weight) as heaviest
        from d_patients, admissions, drgevents, d_codeditems
        where d_patients.subject_id = admissions.subject_id
          and admissions.hadm_id = drgevents.hadm_id and drgevents.itemid = d_codeditems.itemid
        group by sex, type""")
    gold.materialise(spark, MedicalTables(spark, folder), layout, query.key, query)
    return gold.read_gold(spark, layout, query.key)


def adhoc_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A user's SQL with a parameter, straight over the tables."""
    return gold.run_sql(spark, MedicalTables(spark, folder), """
        select d_patients.subject_id, sex, count(*) as num, max(admit_dt) as last_admit_dt
        from admissions join d_patients on admissions.subject_id = d_patients.subject_id
        where admit_dt >= cast(:since as timestamp)
        group by d_patients.subject_id, sex""", {"since": "1998-01-01"})


def result_cache_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A saved query's first run: gold table, then one JSON document per row under its key."""
    layout = _layout(spark, "result-cache")
    query = SavedQuery("patients", "select subject_id, sex, hospital_expire_flg from d_patients")
    gold.Registry(spark, MedicalTables(spark, folder), layout).register_and_run(query)
    return serving.read(spark, layout, query.key)


def cached_rows_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Cached documents of the monthly top twenty, those of some months as columns."""
    layout = _layout(spark, "by-month")
    key = "top20_diseases_by_month"
    registry = gold.Registry(spark, MedicalTables(spark, folder), layout,
                             analyses.GOLD_ANALYSES)
    registry.refresh([key])
    return serving.rows_of_months(serving.read_rows(spark, layout, key), MONTHS)


def variant_rows_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of two analyses in one collection; those of some months as columns."""
    layout, tables = _layout(spark, "variants"), MedicalTables(spark, folder)
    by_month = analyses.top20_diseases_by_month(tables)
    documents.publish(spark, layout, "mixed", [by_month, analyses.patients_by_sex(tables)])
    found = documents.having(documents.read(spark, layout, "mixed"), "month", MONTHS)
    return documents.as_columns(found, by_month.schema)


def _by_year(tables) -> DataFrame:
    return analyses.admissions_deaths_by_year(tables, FIRST_YEAR, LAST_YEAR)


def _refreshed(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Refresh analyses to gold and cache, and read the documents of each key."""
    layout = _layout(spark, "refresh")
    definitions = {**analyses.GOLD_ANALYSES, "admissions_deaths_by_year": _by_year}
    registry = gold.Registry(spark, MedicalTables(spark, folder), layout, definitions,
                             analyses.SHARED)
    registry.refresh(keys)
    documents = [
        serving.read(spark, layout, key).select(F.lit(key).alias("key"), "row") for key in keys
    ]
    return reduce(DataFrame.unionByName, documents)


def refresh_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Three chosen analyses to gold and cache."""
    return _refreshed(spark, folder, SUBSET)


def refresh_all(spark: SparkSession, folder: str) -> DataFrame:
    """All ten analyses to gold and cache; three of them share one join of the facts."""
    return _refreshed(spark, folder, list(analyses.GOLD_ANALYSES))


def decode_payload_query(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON payload of every event as typed columns."""
    messages = read_file(spark, folder, "events").select("event_id", "props")
    return decode_payload(messages, "k bigint", "props")


decode_payload_query.__name__ = "decode_payload"


def _event_stream(layout: Layout, **settings) -> StreamSpec:
    return StreamSpec("events", columns(EVENT_COLUMNS), source_path=f"{layout.root}/incoming",
                      source_options={"timestampFormat": TIMESTAMP_FORMAT}, **settings)


def _arrivals(spark: SparkSession, folder: str, spec: StreamSpec):
    """Deliver all events as CSV files, cut by event id into three arrivals."""
    events = read_file(spark, folder, "events").select(*[c.name for c in spec.columns])
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    arrival = F.expr(f"(event_id - {low}L) * {ARRIVALS} div {high - low + 1}L")
    for number in range(ARRIVALS):
        (
            events.filter(arrival == number).write.mode("append")
            .option("header", True).option("timestampFormat", TIMESTAMP_FORMAT)
            .csv(spec.source_path)
        )
        yield number


def ingest_csv_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files, arriving three times, streamed into the bronze table."""
    layout = _layout(spark, "bronze")
    spec = _event_stream(layout)
    for _ in _arrivals(spark, folder, spec):
        start_bronze(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
    return read_bronze(spark, spec, layout).drop(ARRIVAL)


def stream_append_silver(spark: SparkSession, folder: str) -> DataFrame:
    """Files to bronze to an append-only silver table, in three arrivals."""
    layout = _layout(spark, "append")
    spec = _event_stream(layout, partition_by=("event_type",))
    for _ in _arrivals(spark, folder, spec):
        run_available(spark, spec, layout)
    return read_silver(spark, spec, layout).drop(ARRIVAL)


def stream_merge_silver(spark: SparkSession, folder: str) -> DataFrame:
    """Files to bronze to a silver table with one row per user: the newest of the last arrival."""
    layout = _layout(spark, "merge")
    spec = _event_stream(layout, method=MERGE, merge_keys=("user_id",),
                         order_by=("ts", "event_id"))
    for _ in _arrivals(spark, folder, spec):
        run_available(spark, spec, layout)
    return read_silver(spark, spec, layout).drop(ARRIVAL)


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """Test and train part of the embeddings, 20 % of each label in the test part."""
    return split_by_class(read_file(spark, folder, "embeddings").select("vec_id", "label"),
                          "vec_id", "label")


def _purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Events labelled 1 if they are purchases: about a fifth of them are."""
    return read_file(spark, folder, "events").select(
        "event_id", (F.col("event_type") == "purchase").cast("int").alias("purchase"))


def random_oversample(spark: SparkSession, folder: str) -> DataFrame:
    """All events, and purchases drawn again until there are 0.4 per other event."""
    return oversample(_purchases(spark, folder), "event_id", "purchase")


def random_undersample(spark: SparkSession, folder: str) -> DataFrame:
    """All purchases, and so many other events that there are 0.6 purchases per other event."""
    return undersample(_purchases(spark, folder), "event_id", "purchase")


def resampled_training(spark: SparkSession, folder: str) -> DataFrame:
    """The training rows of a split, resampled: 0.4 by draws, then 0.6 by leaving rows out."""
    train = work_folder(spark, "train")  # read several times
    parts = split_by_class(_purchases(spark, folder), "event_id", "purchase")
    parts.filter("part = 'train'").drop("part").write.parquet(train)
    return classifier.rebalance_classes(spark.read.parquet(train), "event_id", "purchase")


def accuracy_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the 0/1 decision over all events, from a score they carry."""
    scored = read_file(spark, folder, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("purchase"),
        (F.col("value") / (F.col("value") + 100)).alias("score"))
    return classifier.evaluate(scored, "purchase", classifier.THRESHOLD).select(
        "n_rows", "accuracy")


def score_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The 0/1 decision for every event from a score it carries."""
    scored = read_file(spark, folder, "events").select(
        F.col("event_id").alias("encounter_id"),
        (F.col("value") / (F.col("value") + 100)).alias("score"))
    return classifier.decide(scored, "encounter_id", "diabetes_mellitus")


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    scored = read_file(spark, folder, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("purchase"),
        (F.col("value") / (F.col("value") + 100)).alias("score"))
    return curve.precision_recall_curve(scored, "purchase")


def precision_recall_curve(spark: SparkSession, folder: str) -> DataFrame:
    """True and false positives at every score that events carry."""
    return _curve(spark, folder)


def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold with the largest F measure over all events."""
    return curve.best_threshold(_curve(spark, folder))


PATIENT_FILE = "encounter_id bigint, amount double, hour int, subject int, noise int, {} int"
OUTCOME = "diabetes_mellitus"


def _encounters(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled CSV folder, read back: every event with four measures and an outcome.

    The outcome is 1 for amounts of 110 and more (about a tenth of the events); by their id, one
    in forty of those and of the others has the opposite one.
    """
    amount, event = F.col("value"), F.col("event_id")
    outcome = (amount >= 110).cast("int").bitwiseXOR((event * 7919 % 40 == 0).cast("int"))
    path = work_folder(spark, "encounters")
    read_file(spark, folder, "events").select(
        event.alias("encounter_id"), amount.alias("amount"), F.hour("ts").alias("hour"),
        F.col("user_id").alias("subject"), (event * 31 % 101).alias("noise"),
        outcome.alias(OUTCOME),
    ).write.option("header", True).csv(path)
    return read_csv(spark, path, PATIENT_FILE.format(OUTCOME))


def _trained(spark: SparkSession, folder: str) -> tuple[PipelineModel, DataFrame]:
    """A model that was saved and loaded again, and the test part it has not seen."""
    rows = _encounters(spark, folder)
    names = classifier.feature_columns(rows.columns, "encounter_id", OUTCOME)
    split = work_folder(spark, "split")  # read several times, and once more for every score
    split_by_class(classifier.with_features(rows, names, ["encounter_id", OUTCOME]),
                   "encounter_id", OUTCOME).write.parquet(split)
    parts = spark.read.parquet(split)
    training = classifier.rebalance_classes(
        parts.filter("part = 'train'").drop("part"), "encounter_id", OUTCOME)
    path = work_folder(spark, "model")
    classifier.save(classifier.train(training, OUTCOME), path)
    return classifier.load(path), parts.filter("part = 'test'").drop("part")


def classifier_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Split, resample, train, save, load, score and evaluate: is the area under the
    precision-recall curve at least twice what guessing gives?"""
    model, test = _trained(spark, folder)
    result = classifier.evaluate(classifier.score(model, test), OUTCOME, classifier.THRESHOLD)
    return result.select(
        "n_rows", "n_positive",
        (F.col("area_under_pr") >= 2 * F.col("n_positive") / F.col("n_rows"))
        .alias("beats_base_rate"))


def model_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The 0/1 decision of a trained model for every encounter of the test part."""
    model, test = _trained(spark, folder)
    return classifier.decide(classifier.score(model, test), "encounter_id", OUTCOME)


def answer_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A user's SQL as JSON documents and whether the time it took was taken."""
    result = gold.answer(spark, MedicalTables(spark, folder), """
        select admission_type_descr, count(distinct subject_id) as patients
        from demographic_detail group by admission_type_descr""")
    return result.rows.withColumn("timed", F.lit(result.seconds > 0))


SILVER = {  # table -> keys and columns; what tells the lines of an order apart is the key
    "admissions": (("hadm_id",), "hadm_id long!, subject_id long!, admit_dt timestamp, "
                                 "disch_dt timestamp"),
    "drgevents": (("hadm_id", "sequence", "itemid", "supplier", "cost_weight"),
                  "hadm_id long!, sequence integer!, itemid long!, supplier long!, "
                  "cost_weight double!"),
    "d_codeditems": (("itemid",), "itemid long!, code string, type string, description string"),
}


def silver_top5(spark: SparkSession, folder: str) -> DataFrame:
    """Files to bronze to silver, and an analysis over the silver tables."""
    layout, tables = _layout(spark, "silver-top5"), MedicalTables(spark, folder)
    files = {name: tables(name) for name in SILVER}
    files["drgevents"] = read_file(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS hadm_id", "l_linenumber AS sequence", "l_partkey AS itemid",
        "l_suppkey AS supplier", "l_quantity AS cost_weight")
    streams = []
    for name, (keys, text) in SILVER.items():
        spec = StreamSpec(name, columns(text), MERGE, keys,
                          source_path=f"{layout.root}/incoming/{name}",
                          source_options={"timestampFormat": TIMESTAMP_FORMAT})
        files[name].select(*[c.name for c in spec.columns]).write.option("header", True).option(
            "timestampFormat", TIMESTAMP_FORMAT).csv(spec.source_path)
        run_available(spark, spec, layout)
        streams.append(spec)
    return analyses.top5_diseases_by_month(gold.SilverTables(spark, layout, streams))


def stream_keyed_state(spark: SparkSession, folder: str) -> DataFrame:
    """Files to bronze to keyed state, in three arrivals: each user's newest event of all."""
    layout = _layout(spark, "keyed")
    spec = _event_stream(layout, method=MERGE, merge_keys=("user_id",), order_by=("ts", "event_id"))
    for _ in _arrivals(spark, folder, spec):
        start_bronze(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
        start_keyed(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
    return read_keyed(spark, spec, layout).drop(ARRIVAL)


CENTS = "sum(cast(round(value * 100) as decimal(20,0)))"  # exact: the order does not matter
FOLLOWED = {
    # Events and amounts by type and month.
    "events_by_month": incremental.Incremental(
        {"num": "count(*)", "cents": CENTS, "highest": "max(value)"},
        ["event_type", "month(ts) AS month"],
        finish=lambda states: states.select(
            F.concat_ws("/", "event_type", F.col("month").cast("string")).alias("name"),
            "num", F.col("cents").cast("long").alias("amount"), "highest")),
    # Users by the type of their last event: a state per user, counted at the end.
    "users_by_last_type": incremental.Incremental(
        {"last": "max(struct(ts, event_id, event_type, value))"}, ["user_id"],
        finish=lambda states: states.groupBy(F.col("last.event_type").alias("name")).agg(
            F.count(F.lit(1)).alias("num"), F.lit(0).cast("long").alias("amount"),
            F.max("last.value").alias("highest"))),
    # All events.
    "events_in_all": incremental.Incremental(
        {"num": "count(*)", "cents": CENTS, "highest": "max(value)"},
        finish=lambda states: states.select(
            F.lit("all").alias("name"), "num", F.col("cents").cast("long").alias("amount"),
            "highest")),
}


def refresh_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Three gold tables, refreshed after each of three arrivals from the new rows alone."""
    layout = _layout(spark, "incremental")
    spec = _event_stream(layout)
    followed = incremental.IncrementalGold(spark, layout, spec, FOLLOWED)
    for _ in _arrivals(spark, folder, spec):
        start_bronze(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
        followed.refresh()
    results = [gold.read_gold(spark, layout, key).withColumn("key", F.lit(key))
               for key in FOLLOWED]
    return reduce(DataFrame.unionByName, results)


def ingest_messages_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads of all events as messages, published three times and streamed into bronze by a
    query that is started anew for each."""
    layout = _layout(spark, "messages")
    spec = StreamSpec("messages", columns("key long!, k long, segment long"),
                      source_format=message_log.FORMAT, source_path=f"{layout.root}/topic",
                      message_columns=("key", "segment"))
    events = read_file(spark, folder, "events").select("event_id", "props")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    arrival = F.expr(f"(event_id - {low}L) * {ARRIVALS} div {high - low + 1}L")
    for number in range(ARRIVALS):
        message_log.publish(events.filter(arrival == number), spec.source_path,
                            F.col("event_id"), F.col("props"))
        start_bronze(spark, spec, layout, AVAILABLE_NOW).awaitTermination()
    return read_bronze(spark, spec, layout).drop(ARRIVAL)


ITEM_COLUMNS = "itemid bigint, code string, type string, description string"


def codeditems_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """The coded items in a folder per type; one type is replaced, then a few types are counted in
    the events by a join that lists only their folders."""
    tables = MedicalTables(spark, folder)
    path = work_folder(spark, "codeditems")
    items = tables("d_codeditems")
    partitions.replace_partitions(items, path, ["type"])
    changed = items.filter(F.col("type") == REPLACED_TYPE).withColumn(
        "description", F.upper("description"))
    partitions.replace_partitions(changed, path, ["type"])
    kept = partitions.read_partitions(spark, path, ITEM_COLUMNS, ["type"]).filter(
        F.col("type").isin(TYPES))
    counts = tables("drgevents", "itemid").groupBy("itemid").agg(F.count(F.lit(1)).alias("num"))
    return kept.join(counts, "itemid", "left").select(
        "itemid", "type", "description", F.coalesce("num", F.lit(0)).cast("long").alias("num"))


def events_for_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """The chart events of the subjects with most admissions, from files with Bloom filters."""
    tables, path = MedicalTables(spark, folder), work_folder(spark, "lookup")
    events = tables("chartevents")
    lookups.write_lookup(events, path, ["subject_id"])
    often = tables("admissions", "subject_id").groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("num"))
    wanted = top_k(often, [F.desc("num"), F.asc("subject_id")], OFTEN)
    return lookups.rows_of(spark, path, events.schema, "subject_id", wanted)


BUCKETED = {"admissions": ["hadm_id", "admit_dt", "disch_dt"], "drgevents": ["hadm_id", "itemid"]}


def top5_over_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """``top5_diseases_by_month`` over facts in buckets of the admission, joined without a shuffle.
    """
    tables, run = MedicalTables(spark, folder), uuid.uuid4().hex
    buckets = {name: f"{name}_{run}" for name in BUCKETED}
    for name, names in BUCKETED.items():
        lookups.write_buckets(tables(name, *names), buckets[name], work_folder(spark, name),
                              ["hadm_id"], BUCKETS)
    return analyses.top5_diseases_by_month(lookups.BucketedTables(spark, tables, buckets))


ALL = [
    upsert_batch, saved_query_gold, adhoc_sql, result_cache_roundtrip, cached_rows_by_month,
    variant_rows_by_month,
    refresh_subset, refresh_all, decode_payload_query, ingest_csv_bronze,
    stream_append_silver, stream_merge_silver, stratified_split, random_oversample,
    random_undersample, resampled_training, accuracy_at_threshold, score_threshold,
    classifier_eval, model_scoring, answer_documents, silver_top5, stream_keyed_state,
    refresh_incremental, ingest_messages_bronze, codeditems_by_type,
    events_for_subjects, top5_over_buckets,
    precision_recall_curve, best_threshold,
]
