"""The medical tables, derived from the star-schema parquet files in a folder.

Each table is a projection of one file; only ``subject_id`` of the two tables that come from
``lineitem`` needs a second file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Read with a declared schema: no inference job, and timestamps arrive as `timestamp`, so that
# ranges on them reach the parquet scan (a cast in a view would keep them out).
FILE_SCHEMAS = {
    "customer": "c_custkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, "
              "props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def read_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "d_patients": ("customer", {
        "subject_id": "c_custkey",
        "sex": "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
        "dob": "timestamp '1995-01-01' + make_dt_interval(cast(c_custkey * 131 % 2400 AS int))"
               " - make_dt_interval(cast(c_custkey * 7919 % 36500 AS int))",
        "dod": "CASE WHEN c_custkey % 4 != 0 THEN timestamp '1995-01-01'"
               " + make_dt_interval(cast(c_custkey * 131 % 2400 AS int)) END",
        "hospital_expire_flg": "if(c_custkey % 3 = 0, 'Y', 'N')",
    }),
    "admissions": ("orders", {
        "hadm_id": "o_orderkey",
        "subject_id": "o_custkey",
        "admit_dt": "o_orderdate",
        "disch_dt": "o_orderdate + make_dt_interval(cast(o_orderkey % 31 AS int), 6)",
    }),
    "drgevents": ("lineitem", {
        "subject_id": "o_custkey",
        "hadm_id": "l_orderkey",
        "itemid": "l_partkey",
        "cost_weight": "l_quantity",
    }),
    "d_codeditems": ("part", {
        "itemid": "p_partkey",
        "code": "p_brand",
        "type": "p_type",
        "description": "p_name",
    }),
    "demographic_detail": ("orders", {
        "subject_id": "o_custkey",
        "hadm_id": "o_orderkey",
        "admission_type_descr": "CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT'"
                                " WHEN '2-HIGH' THEN 'EMERGENCY' ELSE 'ELECTIVE' END",
    }),
    "icd9": ("lineitem", {
        "subject_id": "o_custkey",
        "hadm_id": "l_orderkey",
        "sequence": "l_linenumber",
        "code": "concat('C', cast(l_suppkey % 20 AS string))",
    }),
    "chartevents": ("events", {
        "subject_id": "user_id",
        "itemid": "event_id % 50",
        "charttime": "ts",
        "value1": "event_type",
        "value1num": "value",
    }),
}


class MedicalTables:
    """``tables(name, *columns)`` gives a table as a DataFrame, all columns by default."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *columns: str) -> DataFrame:
        file, exprs = TABLES[name]
        names = columns or tuple(exprs)
        df = read_file(self.spark, self.folder, file)
        if file == "lineitem" and "subject_id" in names:
            # Every line belongs to exactly one order, so the join changes no row count and
            # is left out when its only column is not asked for.
            orders = read_file(self.spark, self.folder, "orders").select("o_orderkey", "o_custkey")
            df = df.join(orders, df.l_orderkey == orders.o_orderkey)
        return df.selectExpr(*[f"{exprs[c]} AS {c}" for c in names])

    def names(self) -> list[str]:
        return list(TABLES)

    def on(self, spark: SparkSession) -> MedicalTables:
        """The same tables, read by another session."""
        return MedicalTables(spark, self.folder)
