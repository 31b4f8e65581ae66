"""The registered queries, each over whole tables of a folder, and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analyses, flows
from .sources.medical import MedicalTables

# Parameters of the registered queries.
FIRST_YEAR, LAST_YEAR = flows.FIRST_YEAR, flows.LAST_YEAR
ITEM = 42
SUBJECT = 7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _analysis(name: str, function: Callable, **params) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return function(MedicalTables(spark, folder), **params)

    query.__name__, query.__doc__ = name, function.__doc__
    QUERIES[name] = query


_analysis("age_band_counts", analyses.age_band_counts)
_analysis("admissions_deaths_by_year", analyses.admissions_deaths_by_year,
          first=FIRST_YEAR, last=LAST_YEAR)
_analysis("top5_diseases_by_month", analyses.top5_diseases_by_month)
_analysis("stay_days_by_disease", analyses.stay_days_by_disease)
_analysis("top20_common_diseases", analyses.top20_common_diseases)
_analysis("admission_state_mortality", analyses.admission_state_mortality)
_analysis("patients_by_sex", analyses.patients_by_sex)
_analysis("hospital_death_ratio", analyses.hospital_death_ratio)
# The opposite flag: the share of patients who left the hospital alive.
_analysis("hospital_survivor_ratio", analyses.hospital_death_ratio, flag="N")
_analysis("disease_mortality_ratio", analyses.disease_mortality_ratio)
_analysis("top20_diseases_by_month", analyses.top20_diseases_by_month)
_analysis("code_distribution", analyses.code_distribution, itemid=ITEM)
_analysis("events_for_subject", analyses.events_for_subject, subject_id=SUBJECT)
_analysis("latest_admission_per_subject", analyses.latest_admission_per_subject)

for _flow in flows.ALL:
    QUERIES[_flow.__name__] = _flow

# The medical tables in SQL; every oracle below starts with them.
VIEWS = """
WITH d_patients AS (
  SELECT c_custkey AS subject_id,
         CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         TIMESTAMP '1995-01-01' + CAST(c_custkey * 131 % 2400 AS INT) * INTERVAL '1' DAY
           - CAST(c_custkey * 7919 % 36500 AS INT) * INTERVAL '1' DAY AS dob,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE
           TIMESTAMP '1995-01-01' + CAST(c_custkey * 131 % 2400 AS INT) * INTERVAL '1' DAY END AS dod,
         CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS hospital_expire_flg
  FROM customer),
admissions AS (
  SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admit_dt,
         o_orderdate + CAST(o_orderkey % 31 AS INT) * INTERVAL '1' DAY
           + INTERVAL '6' HOUR AS disch_dt
  FROM orders),
drgevents AS (
  SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_partkey AS itemid,
         l_quantity AS cost_weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d_codeditems AS (
  SELECT p_partkey AS itemid, p_brand AS code, p_type AS type, p_name AS description FROM part),
demographic_detail AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'EMERGENCY'
              ELSE 'ELECTIVE' END AS admission_type_descr
  FROM orders),
icd9 AS (
  SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS sequence,
         'C' || CAST(l_suppkey % 20 AS VARCHAR) AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
chartevents AS (
  SELECT user_id AS subject_id, event_id % 50 AS itemid, ts AS charttime,
         event_type AS value1, value AS value1num
  FROM events)
"""


def _oracle(name: str, sql: str) -> None:
    ORACLE_SQL[name] = VIEWS + sql


_oracle("age_band_counts", """
SELECT coalesce(b.name, 'Senior Citizen') AS period, count(*) AS num
FROM (SELECT extract(day FROM dod - dob) / 365 AS years FROM d_patients) p
LEFT JOIN (VALUES (-1e9, 2, 'Infancy'), (2, 6, 'Early Childhood'), (6, 12, 'Later Childhood'),
                  (12, 20, 'Adolescence'), (20, 40, 'Young adult'), (40, 60, 'Middle-aged')
          ) b(low, high, name) ON p.years >= b.low AND p.years < b.high
GROUP BY ALL ORDER BY num DESC, period""")

_oracle("admissions_deaths_by_year", f"""
SELECT a.year AS year, a.num AS num, d.num AS "numDied"
FROM (SELECT year(admit_dt) AS year, count(*) AS num FROM admissions
      WHERE year(admit_dt) BETWEEN {FIRST_YEAR} AND {LAST_YEAR} GROUP BY 1) a
LEFT JOIN (SELECT year(dod) AS year, count(*) AS num FROM d_patients
           WHERE year(dod) BETWEEN {FIRST_YEAR} AND {LAST_YEAR} AND hospital_expire_flg = 'Y'
           GROUP BY 1) d ON a.year = d.year
ORDER BY 1""")

BY_MONTH = """
SELECT row_number() OVER (PARTITION BY month ORDER BY num DESC, itemid, description)
         AS "ROW_NUMBER", itemid, description, month, num
FROM (SELECT i.itemid, i.description, c.month, CAST(sum(c.n) AS BIGINT) AS num
      FROM (SELECT e.itemid, month(a.admit_dt) AS month, count(*) AS n
            FROM admissions a JOIN drgevents e USING (hadm_id) GROUP BY ALL) c
      JOIN d_codeditems i ON i.itemid = c.itemid GROUP BY ALL)"""

_oracle("top5_diseases_by_month", f"""
SELECT * FROM ({BY_MONTH}) WHERE "ROW_NUMBER" < 6""")

_oracle("top20_diseases_by_month", f"""
SELECT itemid, description, month, num AS "numCases" FROM ({BY_MONTH}) WHERE "ROW_NUMBER" < 21""")

_oracle("stay_days_by_disease", """
SELECT i.itemid, i.description, avg(s.days) AS value
FROM d_codeditems i JOIN drgevents e ON e.itemid = i.itemid
JOIN (SELECT hadm_id, extract(day FROM disch_dt - admit_dt) AS days FROM admissions) s
  ON s.hadm_id = e.hadm_id
GROUP BY ALL ORDER BY value DESC NULLS LAST, 1, 2 LIMIT 20""")

_oracle("top20_common_diseases", """
SELECT itemid, description, value
FROM (SELECT drgevents.itemid, description, type, count(*) AS value
      FROM drgevents JOIN d_codeditems ON drgevents.itemid = d_codeditems.itemid
      GROUP BY 1, 2, 3)
ORDER BY value DESC, itemid, description, type LIMIT 20""")

LATEST_ADMISSION = """
SELECT subject_id, hadm_id, admission_type_descr
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
                                   ORDER BY hadm_id DESC, admission_type_descr DESC) AS rn
      FROM demographic_detail) WHERE rn = 1"""

_oracle("latest_admission_per_subject", LATEST_ADMISSION)

_oracle("admission_state_mortality", f"""
SELECT state, count(subject_id) AS total_patients,
       count(CASE WHEN hospital_expire_flg = 'Y' THEN 1 END) AS total_died_patients,
       count(CASE WHEN hospital_expire_flg = 'Y' THEN 1 END)::DOUBLE
         / nullif(count(subject_id), 0) AS ratio
FROM (VALUES ('URGENT'), ('EMERGENCY')) AS s(state)
LEFT JOIN (SELECT d.subject_id, admission_type_descr, hospital_expire_flg
           FROM ({LATEST_ADMISSION}) l JOIN d_patients d ON d.subject_id = l.subject_id) p
  ON p.admission_type_descr = s.state
GROUP BY state""")

_oracle("patients_by_sex", """
SELECT coalesce(sex, 'N/A') AS sex, count(*) AS "numCases" FROM d_patients GROUP BY 1""")

for _name, _flag in (("hospital_death_ratio", "Y"), ("hospital_survivor_ratio", "N")):
    _oracle(_name, f"""
SELECT count(*) AS "TotalPatients",
       count(CASE WHEN hospital_expire_flg = '{_flag}' THEN 1 END) AS "TotalDeathInHospital",
       count(CASE WHEN hospital_expire_flg = '{_flag}' THEN 1 END)::DOUBLE
         / nullif(count(*), 0) AS "ratioOfDeathInHospital"
FROM d_patients""")

_oracle("disease_mortality_ratio", """
SELECT i.itemid, i.type, i.description, r.ratio AS "ratioDied"
FROM d_codeditems i
JOIN (SELECT itemid, count(CASE WHEN hospital_expire_flg = 'Y' THEN 1 END)::DOUBLE / count(*) AS ratio
      FROM (SELECT subject_id, itemid, row_number() OVER (
              PARTITION BY subject_id ORDER BY hadm_id DESC, itemid DESC) AS rn FROM drgevents) l
      JOIN d_patients d ON d.subject_id = l.subject_id
      WHERE rn = 1 GROUP BY itemid) r ON r.itemid = i.itemid
WHERE r.ratio >= 0.8""")

_oracle("code_distribution", f"""
SELECT icd9.code AS code, count(*)::DOUBLE / sum(count(*)) OVER () AS ratio
FROM icd9 JOIN drgevents ON icd9.hadm_id = drgevents.hadm_id
JOIN d_codeditems ON d_codeditems.itemid = drgevents.itemid
WHERE drgevents.itemid = {ITEM}
GROUP BY icd9.code ORDER BY ratio DESC, icd9.code LIMIT 10""")

_oracle("events_for_subject", f"""
SELECT * FROM chartevents WHERE subject_id = {SUBJECT}""")

_oracle("upsert_batch", """
SELECT subject_id, seen, source
FROM (SELECT subject_id, seen, source, row_number() OVER (
        PARTITION BY subject_id ORDER BY batch DESC, seen DESC) AS rn
      FROM (SELECT subject_id, charttime AS seen, 'chart' AS source, 1 AS batch FROM chartevents
            UNION ALL
            SELECT subject_id, admit_dt, 'admission', 2 FROM admissions))
WHERE rn = 1""")

_oracle("saved_query_gold", """
SELECT p.sex, i.type, count(*) AS num, max(e.cost_weight) AS heaviest
FROM d_patients p JOIN admissions a ON a.subject_id = p.subject_id
JOIN drgevents e ON e.hadm_id = a.hadm_id JOIN d_codeditems i ON i.itemid = e.itemid
GROUP BY ALL""")

_oracle("adhoc_sql", """
SELECT d_patients.subject_id AS subject_id, sex, count(*) AS num, max(admit_dt) AS last_admit_dt
FROM admissions JOIN d_patients ON admissions.subject_id = d_patients.subject_id
WHERE admit_dt >= TIMESTAMP '1998-01-01'
GROUP BY 1, 2""")

_oracle("result_cache_roundtrip", """
SELECT '{"subject_id":' || subject_id
       || CASE WHEN sex IS NULL THEN '' ELSE ',"sex":"' || sex || '"' END
       || ',"hospital_expire_flg":"' || hospital_expire_flg || '"}' AS "row"
FROM d_patients""")

_oracle("cached_rows_by_month", f"""
SELECT itemid, description, month, num AS "numCases" FROM ({BY_MONTH})
WHERE "ROW_NUMBER" < 21 AND month IN ({", ".join(map(str, flows.MONTHS))})""")

ORACLE_SQL["variant_rows_by_month"] = ORACLE_SQL["cached_rows_by_month"]

# Fields of the documents, in order; texts are marked with *.
FIELDS = {
    "age_band_counts": "*period num",
    "admissions_deaths_by_year": "year num numDied",
    "top5_diseases_by_month": "ROW_NUMBER itemid *description month num",
    "stay_days_by_disease": "itemid *description value",
    "top20_common_diseases": "itemid *description value",
    "admission_state_mortality": "*state total_patients total_died_patients ratio",
    "patients_by_sex": "*sex numCases",
    "hospital_death_ratio": "TotalPatients TotalDeathInHospital ratioOfDeathInHospital",
    "disease_mortality_ratio": "itemid *type *description ratioDied",
    "top20_diseases_by_month": "itemid *description month numCases",
}


def _documents(key: str) -> str:
    """The rows of an analysis as JSON documents: the fields that are not NULL, in order."""
    fields = ", ".join(
        f"'\"{name.lstrip('*')}\":' || " + (
            f'CAST(to_json("{name[1:]}") AS VARCHAR)' if name[0] == "*" else f'"{name}"')
        for name in FIELDS[key].split())
    return f"SELECT '{key}' AS key, '{{' || concat_ws(',', {fields}) || '}}' AS row"


for _name, _keys in (("refresh_subset", flows.SUBSET),
                     ("refresh_all", list(analyses.GOLD_ANALYSES))):
    ORACLE_SQL[_name] = "\nUNION ALL\n".join(
        f"{_documents(key)} FROM ({ORACLE_SQL[key]})" for key in _keys)

_oracle("answer_documents", """
SELECT '{"admission_type_descr":"' || admission_type_descr || '","patients":'
       || count(DISTINCT subject_id) || '}' AS row, TRUE AS timed
FROM demographic_detail GROUP BY admission_type_descr""")

ORACLE_SQL["silver_top5"] = ORACLE_SQL["top5_diseases_by_month"]

# A fifth of each outcome is the test part; a model that learnt beats the base rate.
_oracle("classifier_eval", """
SELECT CAST(sum(test) AS BIGINT) AS n_rows,
       CAST(sum(test) FILTER (outcome) AS BIGINT) AS n_positive, TRUE AS beats_base_rate
FROM (SELECT (value >= 110) <> (event_id * 7919 % 40 = 0) AS outcome,
             floor(CAST(0.2 AS DOUBLE) * count(*) + 0.5) AS test
      FROM events GROUP BY 1)""")


_oracle("decode_payload", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")

EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM events"
_oracle("ingest_csv_bronze", EVENTS)
_oracle("stream_append_silver", EVENTS)
_oracle("stream_merge_silver", f"""
SELECT event_id, ts, user_id, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                                   ORDER BY arrival DESC, ts DESC, event_id DESC) AS rn
      FROM (SELECT *, (event_id - (SELECT min(event_id) FROM events)) * {flows.ARRIVALS}
                // (SELECT max(event_id) - min(event_id) + 1 FROM events) AS arrival
            FROM ({EVENTS})))
WHERE rn = 1""")

_oracle("stream_keyed_state", f"""
SELECT event_id, ts, user_id, event_type, value
FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
_oracle("ingest_messages_bronze", f"""
SELECT event_id AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       (event_id - (SELECT min(event_id) FROM events)) * {flows.ARRIVALS}
         // (SELECT max(event_id) - min(event_id) + 1 FROM events) AS segment
FROM events""")
_oracle("refresh_incremental", """
, cents AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT 'events_by_month' AS key, event_type || '/' || CAST(month(ts) AS VARCHAR) AS name,
       count(*) AS num, CAST(sum(c) AS BIGINT) AS amount, max(value) AS highest
FROM cents GROUP BY event_type, month(ts)
UNION ALL
SELECT 'users_by_last_type', event_type, count(*), 0, max(value)
FROM (SELECT * FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
GROUP BY event_type
UNION ALL
SELECT 'events_in_all', 'all', count(*), CAST(sum(c) AS BIGINT), max(value) FROM cents""")
_oracle("codeditems_by_type", f"""
SELECT i.itemid, i.type, CASE WHEN i.type = '{flows.REPLACED_TYPE}' THEN upper(i.description)
                              ELSE i.description END AS description, count(e.itemid) AS num
FROM d_codeditems i LEFT JOIN drgevents e ON e.itemid = i.itemid
WHERE i.type IN ({", ".join(f"'{t}'" for t in flows.TYPES)}) GROUP BY ALL""")

_oracle("events_for_subjects", f"""
SELECT * FROM chartevents WHERE subject_id IN (
  SELECT subject_id FROM admissions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {flows.OFTEN})""")
ORACLE_SQL["top5_over_buckets"] = ORACLE_SQL["top5_diseases_by_month"]

CURVE = """
SELECT score, CAST(sum(tp) OVER w AS BIGINT) AS tp, CAST(sum(fp) OVER w AS BIGINT) AS fp
FROM (SELECT value / (value + 100) AS score, count(*) FILTER (event_type = 'purchase') AS tp,
             count(*) FILTER (event_type <> 'purchase') AS fp
      FROM events WHERE value IS NOT NULL GROUP BY 1)
WINDOW w AS (ORDER BY score DESC)"""
_oracle("precision_recall_curve", CURVE)
_oracle("best_threshold", f"""
SELECT score AS threshold, tp, fp,
       (2 * tp)::DOUBLE / (tp + fp + (SELECT max(tp) FROM ({CURVE}))) AS f1
FROM ({CURVE}) ORDER BY f1 DESC, score DESC LIMIT 1""")

HASH = "md5(CAST({} AS VARCHAR) || '42')"
PURCHASES = """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS purchase FROM events"""

_oracle("stratified_split", f"""
SELECT vec_id, label,
       CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {HASH.format("vec_id")}, vec_id)
                 <= floor(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label) + 0.5)
            THEN 'test' ELSE 'train' END AS part
FROM embeddings""")

# The smaller class of the events is the one with label 1.
_oracle("random_undersample", f"""
SELECT event_id, purchase
FROM (SELECT *, row_number() OVER (PARTITION BY purchase
                                   ORDER BY {HASH.format("event_id")}, event_id) AS rn,
             count(*) FILTER (purchase = 1) OVER () AS n_minor
      FROM ({PURCHASES}))
WHERE purchase = 1 OR rn <= floor(n_minor / CAST(0.6 AS DOUBLE))""")

_oracle("random_oversample", f"""
SELECT event_id, purchase FROM ({PURCHASES})
UNION ALL
SELECT m.event_id, m.purchase
FROM (SELECT *, row_number() OVER (ORDER BY {HASH.format("event_id")}, event_id) - 1 AS place
      FROM ({PURCHASES}) WHERE purchase = 1) m
JOIN (SELECT ('0x' || substr({HASH.format("i")}, 1, 15))::BIGINT % n_minor AS place
      FROM (SELECT unnest(range(CAST(floor(CAST(0.4 AS DOUBLE) * n_major) AS BIGINT) - n_minor)) AS i,
                   n_minor
            FROM (SELECT count(*) FILTER (purchase = 1) AS n_minor,
                         count(*) FILTER (purchase = 0) AS n_major FROM ({PURCHASES})))) d
  ON d.place = m.place""")

_oracle("score_threshold", """
SELECT event_id AS encounter_id,
       CASE WHEN value / (value + 100) >= 0.28 THEN 1 ELSE 0 END AS diabetes_mellitus
FROM events""")

_oracle("accuracy_at_threshold", """
SELECT count(*) AS n_rows,
       avg(CASE WHEN (value / (value + 100) >= 0.28) = (event_type = 'purchase')
                THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
FROM events""")

# Split, then draws of the minority, then the cut of the majority, all in hash order.
_oracle("resampled_training", f"""
, labelled AS (SELECT *, {HASH.format("event_id")} AS h FROM ({PURCHASES})),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY purchase ORDER BY h, event_id) AS rn,
         count(*) OVER (PARTITION BY purchase) AS n FROM labelled),
train AS (
  SELECT event_id, purchase, h,
         row_number() OVER (PARTITION BY purchase ORDER BY h, event_id) AS rn
  FROM ranked WHERE rn > floor(CAST(0.2 AS DOUBLE) * n + 0.5)),
sizes AS (SELECT count(*) FILTER (purchase = 1) AS n_minor,
                 CAST(floor(CAST(0.4 AS DOUBLE) * count(*) FILTER (purchase = 0)) AS BIGINT) AS wanted
          FROM train)
SELECT event_id, purchase FROM train WHERE purchase = 1
UNION ALL
SELECT m.event_id, m.purchase
FROM (SELECT unnest(range(wanted - n_minor)) AS i, n_minor FROM sizes) d
JOIN train m ON m.purchase = 1
  AND m.rn - 1 = ('0x' || substr({HASH.format("i")}, 1, 15))::BIGINT % n_minor
UNION ALL
SELECT event_id, purchase FROM train
WHERE purchase = 0 AND rn <= (SELECT floor(wanted / CAST(0.6 AS DOUBLE)) FROM sizes)""")
