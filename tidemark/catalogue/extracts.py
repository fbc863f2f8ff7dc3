"""Files of other systems: the given tables written in their layout, and read back by the library's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.text import ensure_titled_section
from ..plans import rentals, retail
from ..session import scratch_path
from ..sources import clinical, files
from .registry import Entry, Tables

AT = "yyyy-MM-dd HH:mm:ss"


def _text(name: str):
    return F.date_format(name, AT)


def _write(df: DataFrame, root: str, name: str) -> None:
    """A compressed CSV with doubled quotes; every column is text."""
    text = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    text.write.option("compression", "gzip").option("escape", '"').csv(f"{root}/{name}.csv.gz", header=True)


def _admissions(t: Tables) -> DataFrame:
    """Hospital stays from orders; every seventh admission time cannot be read."""
    return t.orders.select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
        F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(_text("o_orderdate")).alias("admittime"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS"), AT).alias("dischtime"), F.col("o_orderpriority").alias("admission_type"),
        F.lit("CLINIC").alias("admission_location"), F.lit("HOME").alias("discharge_location"), F.lit("none").alias("insurance"),
        F.col("o_orderstatus").alias("race"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("hospital_expire_flag"),
    )


def _extract(t: Tables, family: str) -> dict[str, DataFrame]:
    """All tables of a family, with its column names, from orders, customers, lines and parts."""
    newer = family == "iv"
    root, place = scratch_path(t.spark, f"extract-{family}"), clinical.FILES[family]
    born = F.make_date(1930 + F.col("c_nationkey"), 1 + F.col("c_custkey") % 12, F.lit(15))
    person = [(40 + F.col("c_nationkey")).alias("anchor_age"), F.lit(1990).alias("anchor_year")] if newer else [born.alias("dob")]
    gender = F.when(F.col("c_nationkey") < 12, "F").otherwise("M").alias("gender")
    code = "icd_code" if newer else "icd9_code"
    lines = t.lineitem.select("*", F.lit(1).alias("subject_id"), F.col("l_orderkey").alias("hadm_id"))
    number = [F.lit("10").alias("icd_version")] if newer else []
    tables = {
        "patients": t.customer.select(F.col("c_custkey").alias("subject_id"), gender, *person, F.lit(None).cast("string").alias("dod")),
        "admissions": _admissions(t) if newer else _admissions(t).withColumnRenamed("race", "ethnicity"),
        "diagnoses_icd": lines.select("subject_id", "hadm_id", F.col("l_linenumber").alias("seq_num"), F.col("l_partkey").alias(code), *number),
        "d_icd_diagnoses": t.part.where("p_size > 10").select(F.col("p_partkey").alias(code), *number, F.concat("p_type", F.lit(', "'), "p_name", F.lit('"')).alias("long_title")),
        "labevents": lines.select(
            "subject_id", "hadm_id", F.col("l_suppkey").alias("itemid"), _text("l_shipdate").alias("charttime"),
            F.when(F.col("l_linenumber") == 1, "high").otherwise(F.col("l_quantity").cast("string")).alias("valuenum"), F.lit("mg").alias("valueuom"), F.lit(None).cast("string").alias("flag"),
        ),
        "d_labitems": t.supplier.select(F.col("s_suppkey").alias("itemid"), F.col("s_name").alias("label"), F.lit("Blood").alias("fluid"), F.lit("Chemistry").alias("category")),
        "prescriptions": lines.select("subject_id", "hadm_id", _text("l_shipdate").alias("starttime" if newer else "startdate"), F.col("l_partkey").alias("drug"), F.lit("1").alias("dose_val_rx"), F.lit("mg").alias("dose_unit_rx"), F.lit("PO").alias("route")).where("l_returnflag = 'R'"),
        "icustays": lines.where("l_returnflag = 'A'").select("subject_id", "hadm_id", F.col("l_linenumber").alias("stay_id" if newer else "icustay_id"), F.lit("unit").alias("first_careunit"), _text("l_shipdate").alias("intime"), _text("l_shipdate").alias("outtime"), F.lit("1.5").alias("los")),
    }
    for name, df in tables.items():
        _write(df, root, place[name])
    turns = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), F.lit(1).alias("subject_id"), F.col("conv_id").alias("hadm_id"), "role", "turn", "text")
    if newer:
        # two files, of which one lacks the time
        notes = turns.select("note_id", "subject_id", "hadm_id", F.col("role").alias("note_type"), "text", F.lit("2020-01-02 03:04:05").alias("charttime"))
        _write(notes.where("note_type = 'user'"), root, "discharge")
        _write(notes.where("note_type <> 'user'").drop("charttime"), root, "radiology")
        return clinical.load_extract(t.spark, family, root, notes_root=root)
    _write(
        turns.select(
            F.col("note_id").alias("row_id"), "subject_id", "hadm_id", F.col("role").alias("category"), "text",
            F.when(F.col("turn") % 2 == 0, "2020-01-02 03:04:05").alias("charttime"), F.lit("2020-01-02").alias("chartdate"),
            F.when(F.col("turn") == 3, "1").alias("iserror"),
        ),
        root, "NOTEEVENTS",
    )
    return clinical.load_extract(t.spark, family, root)


def listed(t: Tables) -> DataFrame:
    """Files of a written table by name: how many there are, and that the listing knows their sizes and times."""
    root = scratch_path(t.spark, "listing")
    t.nation.write.partitionBy("n_regionkey").csv(root)
    found = files.list_files(t.spark, root).where(F.col("name").endswith(".csv"))
    known = (F.col("size_bytes") > 0) & F.col("modified_at").isNotNull()
    return found.agg(F.count(F.lit(1)).alias("files"), F.bool_and(known).alias("known"))


ADMISSIONS = "subject_id:b hadm_id:b admittime:t dischtime:t age:b los_days:d2"
SQL_ADMISSIONS = """SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS admittime,
    o_orderdate + INTERVAL 36 HOUR AS dischtime, CASE WHEN o_orderkey % 7 <> 0 THEN 1.5 END AS los_days,
    least(90, CASE WHEN o_orderkey % 7 <> 0 THEN {age} END) AS age FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey"""
NOTES = "note_id:s hadm_id:b charttime:t note_type:s text:s"
TITLED = "event_id:b plan:s section_added:B"

ENTRIES = [
    Entry("list_files", "files:b known:B", listed, "SELECT count(DISTINCT n_regionkey) AS files, true AS known FROM {nation}"),
    Entry("clinical_iv_admissions", ADMISSIONS, lambda t: _extract(t, "iv")["admissions"], SQL_ADMISSIONS.format(age="40 + c_nationkey + year(o_orderdate) - 1990")),
    Entry(
        "clinical_iii_admissions", ADMISSIONS, lambda t: _extract(t, "iii")["admissions"],
        SQL_ADMISSIONS.format(age="datesub('year', make_date(1930 + c_nationkey, CAST(1 + c_custkey % 12 AS BIGINT), 15), CAST(o_orderdate AS DATE))"),
    ),
    Entry(
        "clinical_iv_diagnoses", "hadm_id:b seq_num:b icd_code:s icd_version:b long_title:s", lambda t: _extract(t, "iv")["diagnoses"],
        """SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, l_partkey AS icd_code, 10 AS icd_version, p_type || ', "' || p_name || '"' AS long_title
        FROM {lineitem} LEFT JOIN (SELECT * FROM {part} WHERE p_size > 10) ON p_partkey = l_partkey""",
    ),
    Entry(
        "clinical_iii_labs", "hadm_id:b charttime:t itemid:b label:s valuenum:d2 flag:s", lambda t: _extract(t, "iii")["labs"],
        """SELECT l_orderkey AS hadm_id, l_shipdate AS charttime, l_suppkey AS itemid, s_name AS label, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS valuenum,
        NULL AS flag FROM {lineitem} LEFT JOIN {supplier} ON s_suppkey = l_suppkey""",
    ),
    Entry(
        "clinical_iv_notes", NOTES, lambda t: _extract(t, "iv")["notes"],
        """SELECT concat(conv_id, '-', turn) AS note_id, conv_id AS hadm_id, CASE WHEN role = 'user' THEN TIMESTAMP '2020-01-02 03:04:05' END AS charttime,
        role AS note_type, text FROM {conversations}""",
    ),
    Entry(
        "clinical_iii_notes", NOTES, lambda t: _extract(t, "iii")["notes"],
        """SELECT concat(conv_id, '-', turn) AS note_id, conv_id AS hadm_id, CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2020-01-02 03:04:05' ELSE TIMESTAMP '2020-01-02' END
        AS charttime, role AS note_type, text FROM {conversations} WHERE turn <> 3""",
    ),
    Entry(
        "bound_parameter", "month_num:b orders:b",
        lambda t: rentals.months_until(t.orders.groupBy(F.month("o_orderdate").alias("month_num")).agg(F.count(F.lit(1)).alias("orders")), 7),
        "SELECT month(o_orderdate) AS month_num, count(*) AS orders FROM {orders} WHERE month(o_orderdate) <= 7 GROUP BY 1",
    ),
    Entry(
        "policy_text", "content:s",
        lambda t: retail.policy_text(t.region.select(F.col("r_name").alias("topic"), F.concat(F.lit(" Rules of "), "r_name").alias("content")), "AFRICA").unionByName(
            retail.policy_text(t.region.select(F.col("r_name").alias("topic"), F.lit("x").alias("content")), "ATLANTIS")
        ),
        "SELECT concat('Rules of ', r_name) AS content FROM {region} WHERE r_name = 'AFRICA' UNION ALL SELECT 'No policy found for ''ATLANTIS''.' ",
    ),
    Entry(
        "ensure_titled_section", TITLED,
        lambda t: ensure_titled_section(
            t.events.select("event_id", F.when(F.col("value") > 50, "Lock-out first.").when(F.col("value") > 30, "See [s-3]").otherwise("Replace part").alias("plan"), F.when(F.col("event_type") == "view", "A").otherwise("B").alias("kind")),
            t.region.select(
                F.when(F.col("r_regionkey") < 3, "A").otherwise("B").alias("kind"), F.concat(F.lit("S-"), F.col("r_regionkey")).alias("section_id"),
                F.when(F.col("r_regionkey").isin(2, 3, 4), "Lockout of the machine").otherwise("Cleaning").alias("title"), F.lit("Isolate power.").alias("content"),
            ),
            "plan", ["kind"], "lockout",
        ),
        """SELECT event_id, CASE WHEN there THEN plan ELSE concat('Safety first [', section_id, ']: Isolate power.', chr(10), chr(10), plan) END AS plan, NOT there AS section_added
        FROM (SELECT event_id, value > 50 OR (value > 30 AND event_type <> 'view') AS there, CASE WHEN event_type = 'view' THEN 'S-2' ELSE 'S-3' END AS section_id,
          CASE WHEN value > 50 THEN 'Lock-out first.' WHEN value > 30 THEN 'See [s-3]' ELSE 'Replace part' END AS plan FROM {events})""",
    ),
]
