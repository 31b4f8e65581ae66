"""Stream definitions of the thirteen hospital tables."""

from __future__ import annotations

from .spec import APPEND, MERGE, StreamSpec, columns

# Names, types and merge keys of the tables, as the source files declare them.
MERGE_TABLES = {
    "d_patients": (("subject_id",), """
        subject_id integer!, sex string, dob timestamp, dod timestamp,
        hospital_expire_flg string"""),
    "admissions": (("hadm_id",), """
        hadm_id integer!, subject_id integer!, admit_dt timestamp, disch_dt timestamp"""),
    "drgevents": (("hadm_id",), """
        subject_id integer!, hadm_id integer!, itemid integer!, cost_weight float"""),
    "d_codeditems": (("itemid",), """
        itemid integer!, code string, type string, category string, label string,
        description string"""),
    "demographic_detail": (("hadm_id",), """
        subject_id integer!, hadm_id integer!,
        marital_status_itemid integer, marital_status_descr string,
        ethnicity_itemid integer, ethnicity_descr string,
        overall_payor_group_itemid integer, overall_payor_group_descr string,
        religion_itemid integer, religion_descr string,
        admission_type_itemid integer, admission_type_descr string,
        admission_source_itemid integer, admission_source_descr string"""),
    "icd9": (("hadm_id", "sequence"), """
        subject_id integer!, hadm_id integer!, sequence integer!, code string,
        description string"""),
    "icustay_days": (("icustay_id", "seq"), """
        icustay_id integer!, subject_id integer!, seq integer!, begintime timestamp,
        endtime timestamp, first_day_flg string, last_day_flg string"""),
    "icustay_detail": (("icustay_id",), """
        icustay_id integer!, subject_id integer!, gender string, dob timestamp, dod timestamp,
        expire_flg string, subject_icustay_total_num integer, subject_icustay_seq integer,
        hadm_id integer, hospital_total_num integer, hospital_seq integer,
        hospital_first_flg string, hospital_last_flg string, hospital_admit_dt timestamp,
        hospital_disch_dt timestamp, hospital_los integer, hospital_expire_flg string,
        icustay_total_num integer, icustay_seq integer, icustay_first_flg string,
        icustay_last_flg string, icustay_intime timestamp, icustay_outtime timestamp,
        icustay_admit_age float, icustay_age_group string, icustay_los integer,
        icustay_expire_flg string, icustay_first_careunit string, icustay_last_careunit string,
        icustay_first_service string, icustay_last_service string, height float,
        weight_first float, weight_min float, weight_max float, sapsi_first integer,
        sapsi_min integer, sapsi_max integer, sofa_first integer, sofa_min integer,
        sofa_max integer, matched_waveforms_num integer"""),
}
APPEND_TABLES = {
    "chartevents": """
        subject_id integer!, icustay_id integer, itemid integer!, charttime timestamp,
        elemid integer, realtime timestamp, cgid integer, cuid integer, value1 string,
        value1num float, value1uom string, value2 string, value2num float, value2uom string,
        resultstatus string, stopped string""",
    "icustayevents": """
        icustay_id integer!, subject_id integer!, intime timestamp, outtime timestamp,
        los integer, first_careunit integer, last_careunit integer""",
    "ioevents": """
        subject_id integer!, icustay_id integer, itemid integer!, charttime timestamp,
        elemid integer, altid integer, realtime timestamp, cgid integer, cuid integer,
        volume float, volumeuom string, unitshung string, unitshunguom string,
        newbottle integer, stopped string, estimate string""",
    "labevents": """
        subject_id integer!, hadm_id integer!, icustay_id integer, itemid integer!,
        charttime timestamp, value string, valuenum float, flag string, valueuom string""",
    "medevents": """
        subject_id integer!, icustay_id integer, itemid integer!, charttime timestamp,
        elemid integer, realtime timestamp, cgid integer, cuid integer, volume float,
        dose float, doseuom string, solutionid integer, solvolume float, solunits string,
        route string, stopped string""",
}
# End of the fixed values.

# Folders per value pay off only for few values; a folder per subject would mean millions of
# tiny files. So only the type of the coded items has folders, and the event tables, which are
# looked up by subject, are clustered by it.
PARTITIONS = {"d_codeditems": ("type",)}


def hospital_streams(source_root: str) -> list[StreamSpec]:
    """One stream per table, each reading the CSV folder ``{source_root}/{table}``."""
    root = source_root.rstrip("/")
    merges = [
        StreamSpec(name, columns(text), MERGE, keys, PARTITIONS.get(name, ()),
                   source_path=f"{root}/{name}")
        for name, (keys, text) in MERGE_TABLES.items()
    ]
    appends = [
        StreamSpec(name, columns(text), APPEND, cluster_by=("subject_id",),
                   source_path=f"{root}/{name}")
        for name, text in APPEND_TABLES.items()
    ]
    return merges + appends
