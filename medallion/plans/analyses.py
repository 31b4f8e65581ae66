"""The named analyses over the silver tables, as DataFrame functions.

Each takes ``tables``, a callable ``tables(name, *columns) -> DataFrame``, and reads only the
columns it needs. Counts are made on the key of the coded item before the item's texts are
joined, so the facts are shuffled once, as partial counts, and never carry a description.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import band, label_nulls, month_of, ratio, whole_days, within_years, year_of
from ..operators import (
    conditional_distribution,
    latest_per_key,
    sort_bounded,
    top_k,
    top_n_per_group,
)

Tables = Callable[..., DataFrame]

# Names and exclusive upper bounds, in years, of the periods of life.
LIFE_PERIODS = [
    (2, "Infancy"),
    (6, "Early Childhood"),
    (12, "Later Childhood"),
    (20, "Adolescence"),
    (40, "Young adult"),
    (60, "Middle-aged"),
]
LAST_PERIOD = "Senior Citizen"
DAYS_PER_YEAR = 365
STATES = ["URGENT", "EMERGENCY"]
MIN_DEATH_RATIO = 0.8
# End of the fixed values.


def _items(tables: Tables, *texts: str) -> DataFrame:
    """Texts of the coded items, once per distinct combination, with its number of rows."""
    return tables("d_codeditems", "itemid", *texts).groupBy("itemid", *texts).agg(
        F.count(F.lit(1)).alias("_copies"))


def age_band_counts(tables: Tables) -> DataFrame:
    """Patients by period of life at death; without an age at death they count as the last."""
    age = whole_days(F.col("dob"), F.col("dod")) / DAYS_PER_YEAR
    counts = (
        tables("d_patients", "dob", "dod")
        .groupBy(band(age, LIFE_PERIODS, LAST_PERIOD).alias("period"))
        .agg(F.count(F.lit(1)).alias("num"))
    )
    return sort_bounded(counts, [F.desc("num"), F.asc("period")])


def admissions_deaths_by_year(tables: Tables, first: int = 2005, last: int = 2015,
                              flag: str = "Y") -> DataFrame:
    """Admissions per year, and the in-hospital deaths of that year (NULL if there are none)."""
    admitted = (
        tables("admissions", "admit_dt").filter(within_years(F.col("admit_dt"), first, last))
        .groupBy(year_of(F.col("admit_dt")).alias("year")).agg(F.count(F.lit(1)).alias("num"))
    )
    died = (
        tables("d_patients", "dod", "hospital_expire_flg")
        .filter(within_years(F.col("dod"), first, last) & (F.col("hospital_expire_flg") == flag))
        .groupBy(year_of(F.col("dod")).alias("year")).agg(F.count(F.lit(1)).alias("numDied"))
    )
    counts = admitted.join(died, "year", "left").select("year", "num", "numDied")
    return sort_bounded(counts, [F.asc("year")])


def _cases(tables: Tables) -> DataFrame:
    """Item, calendar month of admission and whole days of stay of every coded event: the one
    join of the two fact tables. Columns that an analysis does not use are not read."""
    stay = whole_days(F.col("admit_dt"), F.col("disch_dt"))
    return (
        tables("drgevents", "hadm_id", "itemid")
        .join(tables("admissions", "hadm_id", "admit_dt", "disch_dt"), "hadm_id")
        .select("itemid", month_of(F.col("admit_dt")).alias("month"), stay.alias("days"))
    )


def item_months(tables: Tables) -> DataFrame:
    """Cases, ended stays and their days per item and month; three analyses can start from it."""
    return _cases(tables).groupBy("itemid", "month").agg(
        F.count(F.lit(1)).alias("cases"), F.count("days").alias("stays"),
        F.sum("days").alias("days"))


def _stored(tables: Tables, function: Callable[[Tables], DataFrame]) -> DataFrame | None:
    """The result of ``function``, if a refresh stored it for several analyses."""
    return getattr(tables, "stored", {}).get(function.__name__)


def _cases_by_month(tables: Tables, num: str) -> DataFrame:
    monthly = _stored(tables, item_months)
    if monthly is None:
        monthly = item_months(tables)
    monthly = monthly.select("itemid", "month", "cases")
    return monthly.join(_items(tables, "description"), "itemid").select(
        "itemid", "description", "month", (F.col("cases") * F.col("_copies")).alias(num))


def top5_diseases_by_month(tables: Tables) -> DataFrame:
    """The five most frequent items of each calendar month, with their rank."""
    cases = _cases_by_month(tables, "num")
    order = [F.desc("num"), F.asc("itemid"), F.asc("description")]
    return top_n_per_group(cases, ["month"], order, 5).select(
        "ROW_NUMBER", "itemid", "description", "month", "num")


def top20_diseases_by_month(tables: Tables) -> DataFrame:
    """The twenty most frequent items of each calendar month."""
    cases = _cases_by_month(tables, "numCases")
    order = [F.desc("numCases"), F.asc("itemid"), F.asc("description")]
    return top_n_per_group(cases, ["month"], order, 20).select(
        "itemid", "description", "month", "numCases")


def stay_days_by_disease(tables: Tables, k: int = 20) -> DataFrame:
    """The items with the longest mean stay in whole days."""
    monthly = _stored(tables, item_months)
    if monthly is None:
        mean = _cases(tables).groupBy("itemid").agg(F.avg("days").alias("value"))
    else:
        mean = monthly.groupBy("itemid").agg(ratio(F.sum("days"), F.sum("stays")).alias("value"))
    # Copies of an item's row would repeat every stay alike and leave the mean as it is.
    named = mean.join(_items(tables, "description"), "itemid").select(
        "itemid", "description", "value")
    return top_k(named, [F.desc_nulls_last("value"), F.asc("itemid"), F.asc("description")], k)


def top20_common_diseases(tables: Tables, k: int = 20) -> DataFrame:
    """The most frequent items; items are told apart by their type too, which is not shown."""
    cases = tables("drgevents", "itemid").groupBy("itemid").agg(F.count(F.lit(1)).alias("_cases"))
    named = cases.join(_items(tables, "description", "type"), "itemid").withColumn(
        "value", F.col("_cases") * F.col("_copies"))
    order = [F.desc("value"), F.asc("itemid"), F.asc("description"), F.asc("type")]
    return top_k(named, order, k).select("itemid", "description", "value")


def latest_admission_per_subject(tables: Tables) -> DataFrame:
    """The admission type of each subject's latest admission (the highest admission id)."""
    return latest_per_key(
        tables("demographic_detail", "subject_id", "hadm_id", "admission_type_descr"),
        ["subject_id"], ["hadm_id"])


def admission_state_mortality(tables: Tables, states: list[str] | None = None,
                              flag: str = "Y") -> DataFrame:
    """Patients whose latest admission was of a state, and how many of them died in hospital.

    All counts come from one pass and one row, so a state without patients shows up too.
    """
    states = states or STATES
    latest = latest_admission_per_subject(tables).filter(
        F.col("admission_type_descr").isin(states))
    patients = latest.join(tables("d_patients", "subject_id", "hospital_expire_flg"), "subject_id")
    is_state = [F.col("admission_type_descr") == s for s in states]
    died = F.col("hospital_expire_flg") == flag
    counts = patients.agg(*[
        F.struct(F.lit(s).alias("state"), F.count_if(is_state[i]).alias("total_patients"),
                 F.count_if(is_state[i] & died).alias("total_died_patients")).alias(f"_{i}")
        for i, s in enumerate(states)
    ])
    return (
        counts.select(F.inline(F.array(*[f"_{i}" for i in range(len(states))])))
        .withColumn("ratio", ratio(F.col("total_died_patients"), F.col("total_patients")))
    )


def patients_by_sex(tables: Tables) -> DataFrame:
    """Patients by sex; NULL and the literal label form one group."""
    counts = tables("d_patients", "sex").groupBy(label_nulls(F.col("sex")).alias("sex")).agg(
        F.count(F.lit(1)).alias("numCases"))
    return sort_bounded(counts, [F.col("numCases"), F.col("sex")])


def hospital_death_ratio(tables: Tables, flag: str = "Y") -> DataFrame:
    """All patients, those with the given in-hospital death flag, and their share."""
    flagged = F.count_if(F.col("hospital_expire_flg") == flag)
    return tables("d_patients", "hospital_expire_flg").agg(
        F.count(F.lit(1)).alias("TotalPatients"), flagged.alias("TotalDeathInHospital"),
    ).withColumn("ratioOfDeathInHospital",
                 ratio(F.col("TotalDeathInHospital"), F.col("TotalPatients")))


def disease_mortality_ratio(tables: Tables, at_least: float = MIN_DEATH_RATIO,
                            flag: str = "Y") -> DataFrame:
    """Items for which at least the given share of the patients who had the item in their
    latest record died in hospital."""
    latest = latest_per_key(tables("drgevents", "subject_id", "hadm_id", "itemid"),
                            ["subject_id"], ["hadm_id", "itemid"])
    deadly = (
        latest.join(tables("d_patients", "subject_id", "hospital_expire_flg"), "subject_id")
        .groupBy("itemid").agg(
            ratio(F.count_if(F.col("hospital_expire_flg") == flag), F.count(F.lit(1)))
            .alias("ratioDied"))
        .filter(F.col("ratioDied") >= at_least)
    )
    return (
        tables("d_codeditems", "itemid", "type", "description").join(deadly, "itemid")
        .select("itemid", "type", "description", "ratioDied")
        .orderBy(F.desc("ratioDied"), "itemid")
    )


def code_distribution(tables: Tables, itemid: int, k: int = 10) -> DataFrame:
    """The codes most often recorded in the admissions of an item, as shares of all of them."""
    # One row at most, so it is broadcast: a shuffle by item would send all matches to one task.
    known = tables("d_codeditems", "itemid").filter(F.col("itemid") == itemid).distinct()
    matches = (
        tables("drgevents", "hadm_id", "itemid").filter(F.col("itemid") == itemid)
        .join(F.broadcast(known), "itemid", "left_semi")
    )
    shares = conditional_distribution(tables("icd9", "hadm_id", "code"), matches, "hadm_id", "code")
    return top_k(shares, [F.desc("ratio"), F.asc("code")], k).select("code", "ratio")


def events_for_subject(tables: Tables, subject_id: int) -> DataFrame:
    """All chart events of one subject; the lookup is pushed down to the scan."""
    return tables("chartevents").filter(F.col("subject_id") == subject_id)


# The ten analyses that a refresh materialises, by key.
GOLD_ANALYSES: dict[str, Callable[[Tables], DataFrame]] = {
    "age_band_counts": age_band_counts,
    "admissions_deaths_by_year": admissions_deaths_by_year,
    "top5_diseases_by_month": top5_diseases_by_month,
    "stay_days_by_disease": stay_days_by_disease,
    "top20_common_diseases": top20_common_diseases,
    "admission_state_mortality": admission_state_mortality,
    "patients_by_sex": patients_by_sex,
    "hospital_death_ratio": hospital_death_ratio,
    "disease_mortality_ratio": disease_mortality_ratio,
    "top20_diseases_by_month": top20_diseases_by_month,
}

# Intermediate results that several analyses start from.
SHARED: dict[Callable[[Tables], DataFrame], list[str]] = {
    item_months: ["top5_diseases_by_month", "top20_diseases_by_month", "stay_days_by_disease"],
}
