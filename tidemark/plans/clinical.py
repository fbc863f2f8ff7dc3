"""Admission cohorts, admission detail, and the text for an admission summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import median
from ..operators.context import assemble, fit_budget, section, top_lines
from ..operators.filters import tens
from ..operators.joins import reference_report, spine_join

STAY = ["hadm_id"]
ABNORMAL = "abnormal"


def cohort(
    admissions: DataFrame, diagnoses: DataFrame, icustays: DataFrame, diagnosis: str = "", age: tuple[int, int] = (0, 90),
    types: list[str] | None = None, icu_only: bool = False,
) -> DataFrame:
    """Admissions by age, diagnosis (title contains, or code prefix without dots), type and ICU stay."""
    rows = admissions.where(F.col("age").between(*age))
    needle = diagnosis.strip().lower()
    if needle:
        named = F.coalesce(F.lower("long_title").contains(needle), F.lit(False))
        coded = F.upper("icd_code").startswith(needle.replace(".", "").upper())
        rows = rows.join(diagnoses.where(named | coded).select("hadm_id"), "hadm_id", "left_semi")
    if types:
        rows = rows.where(F.col("admission_type").isin(types))
    if icu_only:
        rows = rows.join(icustays.select("hadm_id"), "hadm_id", "left_semi")
    return rows


def cohort_stats(rows: DataFrame) -> DataFrame:
    """One row: patients, admissions, mortality, median stay.

    Patients are counted apart: beside a distinct count, Spark would keep a median sketch per patient.
    """
    patients = rows.agg(F.countDistinct("subject_id").alias("patients")).scalar()
    sums = rows.agg(
        F.count(F.lit(1)).alias("admissions"),
        F.round(F.lit(100) * F.avg("hospital_expire_flag"), 1).alias("mortality_pct"),
        median(F.col("los_days")).alias("median_los"),
    )
    return sums.select(patients.alias("patients"), "*")


def age_histogram(rows: DataFrame) -> DataFrame:
    """Admissions per ten-year age band."""
    return rows.groupBy(tens(F.col("age")).alias("age_band")).agg(F.count(F.lit(1)).alias("admissions"))


def top_diagnoses(rows: DataFrame, diagnoses: DataFrame, n: int = 10) -> DataFrame:
    """The n most common diagnoses by number of admissions."""
    name = F.coalesce("long_title", "icd_code").alias("diagnosis")
    within = diagnoses.join(rows.select("hadm_id"), "hadm_id", "left_semi").select(name, "hadm_id")
    counts = within.groupBy("diagnosis").agg(F.countDistinct("hadm_id").alias("admissions"))
    return counts.orderBy(F.col("admissions").desc(), "diagnosis").limit(n)


def listing(rows: DataFrame, n: int = 500) -> DataFrame:
    """The first n admissions by time."""
    columns = ["hadm_id", "subject_id", "admittime", "age", "admission_type", "los_days"]
    picked = rows.select(*columns, F.col("hospital_expire_flag").alias("died"))
    return picked.orderBy("admittime", "hadm_id").limit(n)


def lab_counts(labs: DataFrame) -> DataFrame:
    """Numeric results per admission and label."""
    return labs.where(F.col("valuenum").isNotNull()).groupBy(*STAY, "label").agg(F.count(F.lit(1)).alias("n"))


def lab_trend(labs: DataFrame, hadm_id: int, label: str) -> DataFrame:
    """One lab of one admission over time."""
    rows = labs.where((F.col("hadm_id") == hadm_id) & (F.col("label") == label) & F.col("valuenum").isNotNull())
    return rows.select("charttime", "valuenum").orderBy("charttime", "valuenum")


def abnormal_labs(labs: DataFrame) -> DataFrame:
    """Per admission and label: abnormal results, range, last value by time, unit."""
    flagged = labs.where(F.col("flag") == ABNORMAL)
    return flagged.groupBy(*STAY, "label").agg(
        F.count(F.lit(1)).alias("n_abnormal"),
        F.min("valuenum").alias("min_value"),
        F.max("valuenum").alias("max_value"),
        F.max_by("valuenum", F.struct("charttime", "valuenum")).alias("last_value"),
        F.max("valueuom").alias("unit"),
    )


def medications(prescriptions: DataFrame) -> DataFrame:
    """Orders and route per admission and drug."""
    return prescriptions.groupBy(*STAY, "drug").agg(F.count(F.lit(1)).alias("n"), F.max("route").alias("route"))


def icu_stays(icustays: DataFrame) -> DataFrame:
    """ICU stays with the length rounded to a tenth of a day."""
    return icustays.select(*STAY, "stay_id", "first_careunit", "intime", "outtime", F.round("los", 1).alias("los_days"))


def _text(value: str) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit("None"))


def _or(value: str, otherwise: str) -> Column:
    return F.when(F.coalesce(F.col(value), F.lit("")) == "", otherwise).otherwise(F.col(value))


def summary_context(
    admissions: DataFrame, patients: DataFrame, diagnoses: DataFrame, labs: DataFrame, prescriptions: DataFrame,
    icustays: DataFrame, notes: DataFrame | None = None, max_chars: int = 12_000, top: int = 25,
) -> DataFrame:
    """Text per admission: facts, top diagnoses, ICU stays, abnormal labs, medications, note excerpts.

    Notes fill what is left of `max_chars`, oldest first; the whole text is cut there. Lines beyond
    the first `max_chars` of a section could never show, so no more are gathered.
    """
    none = "(none recorded)"
    head = F.concat(
        F.lit("## Admission\nAge "), _text("age"), F.when(F.col("age") >= 90, "+").otherwise(""), F.lit(", "), _or("gender", "unknown sex"),
        F.lit("; "), _text("admission_type"), F.lit(" admission via "), _or("admission_location", "unknown"),
        F.lit("; length of stay "), _text("los_days"), F.lit(" days; discharged to "), _or("discharge_location", "unknown"),
        F.lit("; in-hospital death: "), F.when(F.col("hospital_expire_flag") == 1, "yes").otherwise("no"), F.lit("."),
    )
    dx = F.format_string("%d. %s (%s, ICD-%d)", "seq_num", _or("long_title", "ICD code"), "icd_code", "icd_version")
    stay = F.when(F.col("los").isNotNull(), F.format_string("%s: %.1f days", "first_careunit", "los")).otherwise(F.col("first_careunit"))
    lab = F.concat(
        F.col("label"), F.lit(": "), F.col("n_abnormal"), F.lit("x, "), _text("min_value"), F.lit("-"), _text("max_value"),
        F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(", last "), _text("last_value"),
    )
    drug = F.concat(F.col("drug"), F.lit(" ("), F.col("n"), F.lit(" orders; "), _or("route", "route n/a"), F.lit(")"))
    abnormal = abnormal_labs(labs).withColumn("rank", -F.col("n_abnormal"))
    drugs = medications(prescriptions).withColumn("rank", -F.col("n"))
    parts = [
        top_lines(diagnoses, STAY, ["seq_num", "icd_code", "long_title"], dx, top, "dx_lines"),
        top_lines(icustays, STAY, ["intime", "stay_id"], stay, max_chars, "icu_lines"),
        top_lines(abnormal, STAY, ["rank", "label"], lab, top, "lab_lines"),
        top_lines(drugs, STAY, ["rank", "drug"], drug, top, "drug_lines"),
    ]
    sections = [
        head,
        section("## Diagnoses (by priority)", F.col("dx_lines"), none),
        section("## ICU stays", F.col("icu_lines"), none),
        section("## Labs flagged abnormal (count, min-max, last value)", F.col("lab_lines"), none),
        section("## Medications (most frequent)", F.col("drug_lines"), none),
    ]
    parents = admissions.join(patients.select("subject_id", "gender"), "subject_id", "left")
    out = assemble(parents, parts, STAY, sections)
    if notes is None:
        return out.withColumn("context", F.substring("context", 1, max_chars))
    sized = out.withColumn("used", F.length("context"))
    kept = fit_budget(notes, STAY, ["charttime", "note_id"], "text", sized, "used", max_chars)
    entry = F.concat(F.lit("### "), F.col("note_type"), F.lit(" ("), F.col("charttime").cast("string"), F.lit(")\n"), F.col("excerpt"))
    listed = kept.groupBy(*STAY).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("charttime", "note_id", entry.alias("t")))), lambda x: x["t"]).alias("entries")
    )
    noted = notes.select(*STAY).distinct().withColumn("noted", F.lit(True))
    joined = spine_join(out, [listed, noted], STAY)
    tail = F.when(
        F.col("noted"), F.concat_ws("\n", F.lit("\n## Clinical notes (excerpts)"), F.array_join("entries", "\n"))
    ).otherwise("")
    return joined.select(*STAY, F.substring(F.concat("context", tail), 1, max_chars).alias("context"))


def reference_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphaned rows per table whose admissions must exist."""
    checks = {
        n: (tables[n].where(F.col("hadm_id").isNotNull()), tables["admissions"], STAY)
        for n in ("diagnoses", "icustays", "prescriptions", "labs")
    }
    return reference_report(checks)
