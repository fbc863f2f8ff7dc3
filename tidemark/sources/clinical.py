"""Two families of hospital extracts read into one schema.

Raw columns are text and are cast on the way in. The families differ in a handful of column names,
in how age is given, and in where notes are kept; everything else is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_csv_any, read_optional_union

# Where each family keeps its files.
FILES = {
    "iv": {
        "patients": "hosp/patients",
        "admissions": "hosp/admissions",
        "diagnoses_icd": "hosp/diagnoses_icd",
        "d_icd_diagnoses": "hosp/d_icd_diagnoses",
        "labevents": "hosp/labevents",
        "d_labitems": "hosp/d_labitems",
        "prescriptions": "hosp/prescriptions",
        "icustays": "icu/icustays",
    },
    "iii": {
        "patients": "PATIENTS",
        "admissions": "ADMISSIONS",
        "diagnoses_icd": "DIAGNOSES_ICD",
        "d_icd_diagnoses": "D_ICD_DIAGNOSES",
        "labevents": "LABEVENTS",
        "d_labitems": "D_LABITEMS",
        "prescriptions": "PRESCRIPTIONS",
        "icustays": "ICUSTAYS",
    },
}
AGE_CAP = 90


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _time(name: str) -> Column:
    return F.try_to_timestamp(F.col(name))


def _age(family: str) -> Column:
    if family == "iv":
        years = F.col("anchor_age").cast("int") + F.year(_time("admittime")) - F.col("anchor_year").cast("int")
    else:
        years = F.floor(F.months_between(_time("admittime"), _time("dob")) / 12).cast("int")
    return F.least(years, F.lit(AGE_CAP)).alias("age")


def build_common_schema(raw: dict[str, DataFrame], family: str) -> dict[str, DataFrame]:
    """patients, admissions, diagnoses, labs, prescriptions, icustays from the raw tables of a family."""
    newer = family == "iv"
    ids = [_long("subject_id"), _long("hadm_id")]
    stay = (F.unix_timestamp(_time("dischtime")) - F.unix_timestamp(_time("admittime"))) / 86400

    patients = raw["patients"]
    person = ["anchor_age", "anchor_year"] if newer else ["dob"]
    admissions = raw["admissions"].join(patients.select("subject_id", *person), "subject_id")

    titles = raw["d_icd_diagnoses"]
    if newer:
        coded = raw["diagnoses_icd"]
        dictionary = titles.select("icd_code", "icd_version", "long_title")
        diagnoses = coded.join(dictionary, ["icd_code", "icd_version"], "left")
        code, version = F.col("icd_code"), F.col("icd_version").cast("int")
    else:
        dictionary = titles.select("icd9_code", "long_title")
        diagnoses = raw["diagnoses_icd"].join(dictionary, "icd9_code", "left")
        code, version = F.col("icd9_code"), F.lit(9)

    items = raw["d_labitems"].select("itemid", "label", "fluid", "category")
    labs = raw["labevents"].join(items, "itemid", "left")

    return {
        "patients": patients.select(_long("subject_id"), "gender", _time("dod").cast("date").alias("dod")),
        "admissions": admissions.select(
            *ids,
            _time("admittime").alias("admittime"),
            _time("dischtime").alias("dischtime"),
            "admission_type",
            "admission_location",
            "discharge_location",
            "insurance",
            F.col("race" if newer else "ethnicity").alias("race"),
            F.col("hospital_expire_flag").cast("int").alias("hospital_expire_flag"),
            _age(family),
            F.round(stay, 2).alias("los_days"),
        ),
        "diagnoses": diagnoses.select(
            *ids,
            F.col("seq_num").cast("int").alias("seq_num"),
            code.alias("icd_code"),
            version.alias("icd_version"),
            "long_title",
        ),
        "labs": labs.select(
            *ids,
            _time("charttime").alias("charttime"),
            F.col("itemid").cast("int").alias("itemid"),
            "label",
            "fluid",
            "category",
            F.col("valuenum").try_cast("double").alias("valuenum"),
            "valueuom",
            "flag",
        ),
        "prescriptions": raw["prescriptions"].select(
            *ids, _time("starttime" if newer else "startdate").alias("starttime"), "drug", "dose_val_rx", "dose_unit_rx", "route"
        ),
        "icustays": raw["icustays"].select(
            *ids,
            F.col("stay_id" if newer else "icustay_id").cast("long").alias("stay_id"),
            "first_careunit",
            _time("intime").alias("intime"),
            _time("outtime").alias("outtime"),
            F.col("los").try_cast("double").alias("los"),
        ),
    }


def common_notes(raw: DataFrame, family: str) -> DataFrame:
    """Notes in the common schema: error rows left out, chart date where the chart time is missing."""
    if family == "iv":
        note_id, kind, when = F.col("note_id"), F.col("note_type"), _time("charttime")
    else:
        raw = raw.where(F.col("iserror").isNull() | (F.col("iserror") != "1"))
        note_id, kind = F.col("row_id").cast("string"), F.col("category")
        when = F.coalesce(_time("charttime"), _time("chartdate"))
    return raw.select(
        note_id.alias("note_id"), _long("subject_id"), _long("hadm_id"), when.alias("charttime"), kind.alias("note_type"), "text"
    )


def load_extract(
    spark: SparkSession, family: str, root: str, notes_root: str | None = None, demo: bool = False
) -> dict[str, DataFrame]:
    """Read a family's files and return its tables in the common schema, with `notes` when present."""
    if family not in FILES:
        raise ValueError(f"unknown family {family!r}; choose from {sorted(FILES)}")
    tables = build_common_schema({n: read_csv_any(spark, root, rel) for n, rel in FILES[family].items()}, family)
    if family == "iv" and notes_root:
        tables["notes"] = common_notes(read_optional_union(spark, notes_root, ["discharge", "radiology"]), family)
    elif family == "iii" and not demo:
        tables["notes"] = common_notes(read_csv_any(spark, root, "NOTEEVENTS", multiline=True), family)
    return tables
