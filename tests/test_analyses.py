"""Corner cases of the analyses on tiny tables."""

from datetime import datetime, timedelta

from conftest import rows

from medallion.plans import analyses


class Fixed:
    def __init__(self, **tables):
        self.tables = tables

    def __call__(self, name, *columns):
        df = self.tables[name]
        return df.select(*columns) if columns else df


def _patients(spark, data):
    return spark.createDataFrame(
        data, "subject_id int, sex string, dob timestamp, dod timestamp, hospital_expire_flg string")


def test_periods_at_exact_ages(spark):
    born = datetime(1900, 1, 1)
    data = [(i, "F", born, born + timedelta(days=365 * years), "Y")
            for i, years in enumerate((1, 2, 6, 12, 20, 40, 60))]
    data.append((9, "F", born, None, "N"))
    result = dict(rows(analyses.age_band_counts(Fixed(d_patients=_patients(spark, data)))))
    assert result == {"Infancy": 1, "Early Childhood": 1, "Later Childhood": 1, "Adolescence": 1,
                      "Young adult": 1, "Middle-aged": 1, "Senior Citizen": 2}


def test_a_year_without_deaths_shifts_nothing(spark):
    admissions = spark.createDataFrame(
        [(datetime(y, 5, 1),) for y in (2005, 2006, 2006, 2007, 2016)], "admit_dt timestamp")
    patients = _patients(spark, [
        (1, "F", None, datetime(2005, 12, 31), "Y"), (2, "F", None, datetime(2007, 1, 1), "Y"),
        (3, "F", None, datetime(2007, 1, 1), "N"), (4, "F", None, datetime(2004, 1, 1), "Y")])
    tables = Fixed(admissions=admissions, d_patients=patients)
    assert rows(analyses.admissions_deaths_by_year(tables)) == [
        (2005, 1, 1), (2006, 2, None), (2007, 1, 1)]


def test_states_without_patients_are_shown(spark):
    detail = spark.createDataFrame(
        [(1, 1, "URGENT"), (1, 2, "ELECTIVE"), (2, 1, "URGENT"), (3, 1, "URGENT"), (4, 4, "URGENT")],
        "subject_id int, hadm_id int, admission_type_descr string")
    patients = _patients(spark, [(i, "F", None, None, "Y" if i == 3 else "N") for i in (1, 2, 3)])
    tables = Fixed(demographic_detail=detail, d_patients=patients)
    assert rows(analyses.admission_state_mortality(tables)) == [
        ("EMERGENCY", 0, 0, None), ("URGENT", 2, 1, 0.5)]


def test_death_flags(spark):
    patients = _patients(spark, [(i, None, None, None, f) for i, f in enumerate("YNNN")])
    tables = Fixed(d_patients=patients)
    assert rows(analyses.hospital_death_ratio(tables)) == [(4, 1, 0.25)]
    assert rows(analyses.hospital_death_ratio(tables, flag="N")) == [(4, 3, 0.75)]
    empty = Fixed(d_patients=patients.filter("subject_id < 0"))
    assert rows(analyses.hospital_death_ratio(empty)) == [(0, 0, None)]


def _items(spark):
    # Item 1 is listed twice with the same texts, item 2 twice with different ones.
    return spark.createDataFrame(
        [(1, "c", "t", "one"), (1, "c", "t", "one"), (2, "c", "t", "two"), (2, "c", "u", "zwei"),
         (3, "c", "t", "three")], "itemid int, code string, type string, description string")


def test_counts_with_items_listed_twice_equal_the_plain_join(spark):
    events = spark.createDataFrame(
        [(1, 10, 1), (1, 10, 2), (2, 20, 2), (2, 20, 9), (3, 30, 1), (3, None, 1)],
        "subject_id int, hadm_id int, itemid int")
    admissions = spark.createDataFrame(
        [(10, datetime(2000, 1, 5), datetime(2000, 1, 9)),
         (20, datetime(2001, 1, 5), datetime(2001, 1, 6)),
         (30, datetime(2001, 3, 5), None)],
        "hadm_id int, admit_dt timestamp, disch_dt timestamp")
    tables = Fixed(drgevents=events, admissions=admissions, d_codeditems=_items(spark))
    for name, df in tables.tables.items():
        df.createOrReplaceTempView(f"plain_{name}")
    joined = """plain_drgevents e join plain_d_codeditems i on e.itemid = i.itemid
                join plain_admissions a on a.hadm_id = e.hadm_id"""
    plain = spark.sql(f"""select e.itemid, description, cast(month(admit_dt) as bigint) month,
                          count(*) n from {joined} group by 1, 2, 3""")
    assert rows(analyses.top20_diseases_by_month(tables)) == rows(plain)
    stays = spark.sql(f"""select e.itemid, description,
                          avg(extract(day from disch_dt - admit_dt)) v from {joined} group by 1, 2""")
    assert rows(analyses.stay_days_by_disease(tables)) == rows(stays)
    common = spark.sql("""select e.itemid, description, count(*) n from plain_drgevents e
                          join plain_d_codeditems i on e.itemid = i.itemid
                          group by e.itemid, description, type""")
    assert rows(analyses.top20_common_diseases(tables)) == rows(common)


def test_disease_mortality_uses_the_latest_record_only(spark):
    events = spark.createDataFrame(
        [(1, 1, 3), (1, 2, 1), (2, 1, 1), (3, 1, 3)], "subject_id int, hadm_id int, itemid int")
    patients = _patients(spark, [(1, "F", None, None, "Y"), (2, "F", None, None, "Y"),
                                 (3, "F", None, None, "N")])
    tables = Fixed(drgevents=events, d_patients=patients, d_codeditems=_items(spark))
    # Both rows of item 1 are shown; item 3 had one survivor; item 2 has no patient.
    assert rows(analyses.disease_mortality_ratio(tables)) == [(1, "t", "one", 1.0)] * 2
    assert rows(analyses.disease_mortality_ratio(tables, at_least=0.0)) == [
        (1, "t", "one", 1.0), (1, "t", "one", 1.0), (3, "t", "three", 0.0)]


def test_codes_of_an_unknown_item(spark):
    icd9 = spark.createDataFrame([(1, "a")], "hadm_id int, code string")
    events = spark.createDataFrame([(1, 8), (1, 1)], "hadm_id int, itemid int")
    tables = Fixed(icd9=icd9, drgevents=events, d_codeditems=_items(spark))
    assert rows(analyses.code_distribution(tables, 8)) == []
    assert rows(analyses.code_distribution(tables, 1)) == [("a", 1.0)]
