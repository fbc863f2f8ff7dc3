"""Change histories, maintenance, sources and sinks."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import cdc, maintenance
from tidemark.plans import inventory, spend, support
from tidemark.session import scratch_path
from tidemark.sources import clinical, files, tables
from tidemark.streaming import incremental

SPEC = cdc.ChangeSpec(keys=["id"])
CHANGES = "id string, name string, _pg_change_type string, _pg_lsn long, _pg_xid long, _timestamp timestamp, _sort_by long"
HISTORY = [
    ("a", "one", "insert", 1), ("a", "two", "update", 5), ("a", "late", "update", 3),
    ("b", "one", "insert", 2), ("b", None, "delete", 6), ("b", "late", "update", 4),
    ("c", "one", "insert", 3), ("c", None, "delete", 7), ("c", "back", "insert", 9),
    ("d", "only", "insert", 8),
]
NOW = dt.datetime(2024, 5, 1)


def history(spark, data=HISTORY):
    return spark.createDataFrame([(k, n, op, lsn, 0, NOW, lsn) for k, n, op, lsn in data], CHANGES)


def test_current_state(spark):
    state = cdc.current_state(history(spark), SPEC)
    assert state.columns == ["id", "name"]
    assert rows(state) == [("a", "two"), ("c", "back"), ("d", "only")]


@pytest.mark.parametrize("order", [1, -1, 3])
def test_stream_equals_batch(spark, order):
    """Changes arriving in three batches, in order, reversed and interleaved, give the batch result."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("source", "out", "checkpoint"))
    arranged = sorted(HISTORY, key=lambda r: (r[3] * order) % 11)
    for part in (arranged[:4], arranged[4:7], arranged[7:]):
        history(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = files.read_change_log(spark, source, history(spark).schema, stream=True, spec=SPEC)
        incremental.scd1_stream(stream, SPEC, out, checkpoint).awaitTermination()
    assert rows(incremental.scd1_current(spark, out, SPEC)) == rows(cdc.current_state(history(spark), SPEC))


SALES = "id string, store_id string, product_id string, quantity_sold int, unit_price_cents int, sold_at timestamp, _pg_change_type string, _pg_lsn long"
SOLD = [
    ("1", "s", "p", 2, 100, dt.datetime(2024, 1, 1, 23), "insert", 1),
    ("1", "s", "p", 3, 100, dt.datetime(2024, 1, 1, 23), "update", 2),
    ("2", "s", "p", 4, 50, dt.datetime(2024, 1, 2), "insert", 3),
    ("2", "s", "p", 4, 50, dt.datetime(2024, 1, 2), "delete", 4),
]
MEASURES = {"units_sold": "quantity_sold", "revenue_cents": "quantity_sold * unit_price_cents"}


def measured():
    return {n: F.expr(e) for n, e in MEASURES.items()}


def test_daily_totals_add_updates_unless_netted(spark):
    sold = spark.createDataFrame(SOLD, SALES)
    day = dt.date(2024, 1, 1)
    args = (["store_id", "product_id"], "sold_at", "sale_date", measured(), SPEC)
    assert rows(cdc.daily_totals(sold, *args)) == [("s", "p", day, 5, 500), ("s", "p", dt.date(2024, 1, 2), 4, 200)]
    assert rows(cdc.daily_totals(sold, *args, net_updates=True)) == [("s", "p", day, 3, 300)]


@pytest.mark.parametrize("watermark", [None, "10 days"])
def test_daily_stream(spark, watermark):
    source, out, checkpoint = (scratch_path(spark, n) for n in ("sales", "daily", "checkpoint"))
    for part in (SOLD[:2], SOLD[2:]):
        spark.createDataFrame(part, SALES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SALES).parquet(source)
        incremental.daily_totals_stream(
            stream, ["store_id", "product_id"], "sold_at", "sale_date", measured(), SPEC, out, checkpoint, watermark
        ).awaitTermination()
    latest = incremental.latest_versions(spark, out, ["store_id", "product_id", "sale_date"])
    batch = cdc.daily_totals(spark.createDataFrame(SOLD, SALES), ["store_id", "product_id"], "sold_at", "sale_date", measured(), SPEC)
    assert rows(latest, *batch.columns) == rows(batch)


def test_publish_continuous(spark):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("changes", "serving", "checkpoint"))
    spark.createDataFrame([("a", 1)], "id string, v int").write.parquet(target)
    spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int").write.parquet(source)
    stream = spark.readStream.schema("id string, v int").parquet(source)
    incremental.publish_continuous(stream, lambda b: tables.upsert_table(b.sparkSession, target, b, ["id"]), checkpoint).awaitTermination()
    assert rows(spark.read.parquet(target)) == [("a", 2), ("b", 3)]


def test_change_log_needs_its_columns(spark):
    with pytest.raises(ValueError, match="_pg_lsn"):
        files.read_change_log(spark, "/nowhere", spark.createDataFrame([], "id string, _pg_change_type string").schema, spec=SPEC)


def test_upserts(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    source = spark.createDataFrame([("B", 2), ("c", 3)], "v string, k long")
    assert rows(maintenance.upsert(target, source, ["k"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(maintenance.insert_new(target, source, ["k"]), "k", "v") == [(3, "c")]
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "k long, v string, n long")
    assert rows(maintenance.upsert(target, twice, ["k"], ["n"])) == [(1, "a"), (2, "y")]
    assert rows(maintenance.delete_by_key(target, source, ["k"])) == [(1, "a")]
    assert rows(maintenance.guarded_insert(source, target, ["k"]), "k") == [(2,)]


def test_partial_update_and_status_change(spark):
    subs = spark.createDataFrame(
        [("1", "n1", "active", None, NOW), ("2", "n2", "trial", None, NOW)],
        "id string, name string, status string, cancellation_date date, updated_at timestamp",
    )
    patch = spark.createDataFrame([("1", "new", None)], "id string, name string, status string")
    assert rows(spend.edit(subs, patch, ["name", "status"]), "id", "name", "status") == [("1", "new", "active"), ("2", "n2", "trial")]
    changes = spark.createDataFrame([("1", "cancelled"), ("2", "active")], "id string, status string")
    today = dt.date(2024, 6, 1)
    changed = spend.change_status(subs, changes, F.lit(today), F.lit(dt.datetime(2024, 6, 1)))
    assert rows(changed, "id", "status", "cancellation_date") == [("1", "cancelled", today), ("2", "active", None)]


def test_delete_from_time(spark):
    messages = spark.createDataFrame([("m1", "c", 1), ("m2", "c", 2), ("m3", "d", 9)], "id string, chat string, at long")
    votes = spark.createDataFrame([("m1", True), ("m2", False), ("m3", True)], "message_id string, up boolean")
    cuts = spark.createDataFrame([("c", 2)], "chat string, cut long")
    kept, left = maintenance.delete_from_time(messages, votes, "chat", "at", cuts, "id", "message_id")
    assert rows(kept, "id") == [("m1",), ("m3",)]
    assert rows(left, "message_id") == [("m1",), ("m3",)]


def test_received_orders_never_push_stock_below_zero(spark):
    stock = spark.createDataFrame([("s", "p", 5, 3, NOW), ("s", "q", 1, 9, NOW)], "store_id string, product_id string, quantity_on_hand int, quantity_on_order int, last_counted_at timestamp")
    orders = spark.createDataFrame([("s", "p", 4)], "store_id string, product_id string, quantity_ordered int")
    now = F.lit(dt.datetime(2024, 6, 1))
    received = inventory.receive_orders(stock, orders, now)
    assert rows(received, "product_id", "quantity_on_hand", "quantity_on_order") == [("p", 9, 0), ("q", 1, 9)]
    placed = inventory.place_orders(stock, orders, now)
    assert rows(placed, "product_id", "quantity_on_order") == [("p", 7), ("q", 9)]


def test_decisions_are_idempotent(spark):
    cases = spark.createDataFrame([("k1", "u", "open"), ("k2", "u", "open"), ("k3", "u", "resolved")], "id string, user_id string, status string")
    orders = spark.createDataFrame([("o1", "u", 500, 1), ("o2", "u", 300, 2)], "id string, user_id string, total_in_cents long, created_at long")
    decisions = spark.createDataFrame(
        [("d1", "k1", "adm", "refund", 400, "sorry", 1), ("d2", "k1", "adm", "resolve", 0, "done", 2), ("d3", "k2", "adm", "credit", 50, "ok", 1), ("d4", "k3", None, "refund", 0, "x", 1)],
        "id string, case_id string, admin_id string, action string, amount_cents long, response string, decided_at long",
    )
    out = support.decision_outputs(decisions, cases, orders)
    assert rows(out["refunds"], "decision_id", "order_id", "amount_in_cents") == [("d1", "o2", 300)]
    assert rows(out["credits"], "decision_id", "amount_in_cents") == [("d3", 50)]
    assert rows(out["messages"], "decision_id") == [("d1",), ("d2",), ("d3",)]
    assert rows(out["case_status"], "id", "status") == [("k1", "resolved"), ("k2", "in_progress")]
    target = scratch_path(spark, "refunds")
    out["refunds"].write.parquet(target)
    tables.insert_new_rows(spark, target, out["refunds"], ["decision_id"])
    assert spark.read.parquet(target).count() == 1


def test_unanswered(spark):
    cases = spark.createDataFrame([("c1", "u", "s", "open"), ("c2", "u", "s", "resolved"), ("c3", "u", "s", "in_progress")], "id string, user_id string, subject string, status string")
    messages = spark.createDataFrame(
        [("m1", "c1", None, 1), ("m2", "c1", None, 2), ("m3", "c1", "adm", 3), ("m4", "c2", None, 1), ("m5", "c3", None, 1), ("m6", "c3", None, 2)],
        "id string, case_id string, admin_id string, created_at long",
    )
    responses = spark.createDataFrame([("m6",)], "message_id string")
    # An admin reply does not hide m2; with m6 answered the older m5 surfaces.
    assert rows(cdc.unanswered(messages, cases, responses), "message_id") == [("m2",), ("m5",)]


def test_table_sinks(spark):
    target = scratch_path(spark, "table")
    tables.overwrite(spark.createDataFrame([(1,)], "a long"), target)
    tables.overwrite(spark.createDataFrame([("x", 2)], "b string, c long"), target)
    assert spark.read.parquet(target).columns == ["b", "c"]
    tables.publish_snapshot(spark.read.parquet(target), target + "-copy")
    assert rows(spark.read.parquet(target + "-copy")) == [("x", 2)]
    log = scratch_path(spark, "log")
    for i in range(2):
        tables.append_log(spark.createDataFrame([(i,)], "a long"), log, spark)
    assert spark.read.parquet(log).count() == 2
    with pytest.raises(ValueError):
        tables.append_log(spark.createDataFrame([("x",)], "b string"), log, spark)


def test_upsert_table_rewrites_touched_partitions_only(spark):
    target = scratch_path(spark, "parted")
    schema = "k long, v string, day string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], schema).write.partitionBy("day").parquet(target)
    untouched = {r.name for r in files.list_files(spark, f"{target}/day=y").collect()}
    tables.upsert_table(spark, target, spark.createDataFrame([(2, "B", "x"), (4, "d", "z")], schema), ["k"], partition="day")
    assert rows(spark.read.parquet(target), "k", "v", "day") == [(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (4, "d", "z")]
    assert {r.name for r in files.list_files(spark, f"{target}/day=y").collect()} == untouched


def test_upsert_keeps_columns_the_source_lacks(spark):
    target = scratch_path(spark, "wide")
    spark.createDataFrame([(1, 2, "a"), (2, 3, "b")], "id long, x long, extra string").write.parquet(target)
    tables.upsert_table(spark, target, spark.createDataFrame([(2, 9), (3, 1)], "id long, x long"), ["id"])
    assert rows(spark.read.parquet(target), "id", "x", "extra") == [(1, 2, "a"), (2, 9, "b"), (3, 1, None)]
    for bad in ("id long, y long", "id long, x string"):
        with pytest.raises(ValueError):
            tables.upsert_table(spark, target, spark.createDataFrame([], bad), ["id"])


def test_repeated_source_keys_need_an_order(spark):
    target = spark.createDataFrame([(1, 2)], "id long, x long")
    twice = spark.createDataFrame([(1, 5), (1, 7), (None, 1), (None, 1)], "id long, x long")
    with pytest.raises(Exception, match="several source rows"):
        maintenance.upsert(target, twice, ["id"]).collect()
    assert rows(maintenance.upsert(target, twice, ["id"], ["x"])) == sorted([(1, 7), (None, 1), (None, 1)], key=repr)


def test_a_switch_that_breaks_off_is_recovered(spark, monkeypatch):
    target = scratch_path(spark, "broken")
    spark.createDataFrame([(1, 2)], "id long, x long").write.parquet(target)
    old = f"{target.rsplit('/', 1)[0]}/.old.{target.rsplit('/', 1)[1]}"
    handle, place = tables._files(spark, target)
    assert handle.rename(place, tables._files(spark, old)[1])  # as if the job died between the two renames
    tables.upsert_table(spark, target, spark.createDataFrame([(1, 3)], "id long, x long"), ["id"])
    assert rows(spark.read.parquet(target)) == [(1, 3)]
    assert not handle.exists(tables._files(spark, old)[1])
    monkeypatch.setattr(tables, "switch", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        tables.upsert_table(spark, target, spark.createDataFrame([(1, 4)], "id long, x long"), ["id"])
    assert rows(spark.read.parquet(target)) == [(1, 3)]
    left = handle.listStatus(tables._files(spark, target)[1].getParent())
    assert not [s for s in left if ".next.broken" in s.getPath().getName()]


def test_compaction_keeps_the_newest_rows(spark):
    path = scratch_path(spark, "folds")
    assert incremental.latest_versions(spark, path, ["id"], spark.createDataFrame([], "id long, x long").schema).count() == 0
    for batch, data in enumerate([[(1, 1), (2, 1)], [(2, 2)], [(3, 3)], [(1, 4)]]):
        spark.createDataFrame(data, "id long, x long").write.parquet(f"{path}/batch_id={batch}")
    before = rows(incremental.latest_versions(spark, path, ["id"]))
    assert incremental.compact_versions(spark, path, ["id"]) == 2
    assert rows(incremental.latest_versions(spark, path, ["id"])) == before == [(1, 4), (2, 2), (3, 3)]
    assert rows(spark.read.parquet(path).select("batch_id").distinct()) == [(2,), (3,)]


def test_bootstrap_and_provenance(spark):
    for _ in range(2):
        tables.create_if_missing(spark, "boot.log", "a string, b int")
    assert spark.table("boot.log").columns == ["a", "b"]
    row = tables.provenance(spark, "demo", False, True, "open").first()
    assert (row.dataset, row.credentialed, row.has_notes, row.license) == ("demo", False, True, "open") and row.loaded_at


def write(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    opener = gzip.open if zipped else open
    with opener(path, "wt") as out:
        out.write(text)


IV = {
    "hosp/patients": "subject_id,gender,anchor_age,anchor_year,dod\n1,F,60,2100,2105-01-02\n2,M,95,2100,\n",
    "hosp/admissions": "subject_id,hadm_id,admittime,dischtime,admission_type,admission_location,discharge_location,insurance,race,hospital_expire_flag\n"
    "1,10,2103-01-01 00:00:00,2103-01-02 12:00:00,URGENT,ER,HOME,X,W,0\n2,20,2101-01-01 00:00:00,2101-01-03 00:00:00,EW,ER,,X,W,1\n",
    "hosp/diagnoses_icd": "subject_id,hadm_id,seq_num,icd_code,icd_version\n1,10,1,I50,10\n1,10,2,4280,9\n",
    "hosp/d_icd_diagnoses": "icd_code,icd_version,long_title\nI50,10,Heart failure\nI50,9,Wrong\n",
    "hosp/labevents": "subject_id,hadm_id,itemid,charttime,valuenum,valueuom,flag\n1,10,5,2103-01-01 01:00:00,1.5,mg,abnormal\n1,,5,2103-01-01 02:00:00,___,mg,\n",
    "hosp/d_labitems": "itemid,label,fluid,category\n5,Glucose,Blood,Chemistry\n",
    "hosp/prescriptions": "subject_id,hadm_id,starttime,drug,dose_val_rx,dose_unit_rx,route\n1,10,2103-01-01 03:00:00,Aspirin,81,mg,PO\n",
    "icu/icustays": "subject_id,hadm_id,stay_id,first_careunit,intime,outtime,los\n1,10,7,MICU,2103-01-01 00:00:00,2103-01-02 00:00:00,1.0\n",
}
III = {
    "PATIENTS": "ROW_ID,SUBJECT_ID,GENDER,DOB,DOD\n1,1,F,2040-06-01 00:00:00,\n2,2,M,1800-01-01 00:00:00,\n",
    "ADMISSIONS": "SUBJECT_ID,HADM_ID,ADMITTIME,DISCHTIME,ADMISSION_TYPE,ADMISSION_LOCATION,DISCHARGE_LOCATION,INSURANCE,ETHNICITY,HOSPITAL_EXPIRE_FLAG\n"
    "1,10,2100-05-31 00:00:00,2100-06-02 00:00:00,URGENT,ER,HOME,X,W,0\n2,20,2100-01-01 00:00:00,2100-01-02 00:00:00,EW,ER,HOME,X,W,0\n",
    "DIAGNOSES_ICD": "SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,10,1,4280\n",
    "D_ICD_DIAGNOSES": "ICD9_CODE,LONG_TITLE\n4280,Congestive heart failure\n",
    "LABEVENTS": "SUBJECT_ID,HADM_ID,ITEMID,CHARTTIME,VALUENUM,VALUEUOM,FLAG\n1,10,5,2100-06-01 00:00:00,2,mg,\n",
    "D_LABITEMS": "ITEMID,LABEL,FLUID,CATEGORY\n5,Glucose,Blood,Chemistry\n",
    "PRESCRIPTIONS": "SUBJECT_ID,HADM_ID,STARTDATE,DRUG,DOSE_VAL_RX,DOSE_UNIT_RX,ROUTE\n1,10,2100-06-01 00:00:00,Aspirin,81,mg,PO\n",
    "ICUSTAYS": "SUBJECT_ID,HADM_ID,ICUSTAY_ID,FIRST_CAREUNIT,INTIME,OUTTIME,LOS\n1,10,7,MICU,2100-06-01 00:00:00,2100-06-02 00:00:00,x\n",
    "NOTEEVENTS": 'ROW_ID,SUBJECT_ID,HADM_ID,CHARTDATE,CHARTTIME,CATEGORY,ISERROR,TEXT\n1,1,10,2100-06-01,,Nursing,,"line one\nsaid ""ok"", two"\n'
    "2,1,10,2100-06-01,2100-06-01 05:00:00,Nursing,1,wrong patient\n",
}


def test_both_families_share_one_schema(spark, tmp_path):
    for i, (name, text) in enumerate(IV.items()):
        write(tmp_path / "iv" / f"{name}{'.csv.gz' if i % 2 else '.csv'}", text, zipped=bool(i % 2))
    for name, text in III.items():
        write(tmp_path / "iii" / f"{name}.csv", text)
    write(tmp_path / "notes" / "discharge.csv.gz", "note_id,subject_id,hadm_id,note_type,charttime,text\nn1,1,10,DS,2103-01-02 00:00:00,fine\n", True)
    write(tmp_path / "notes" / "radiology.csv", "note_id,subject_id,hadm_id,note_type,text\nr1,1,10,RR,clear\n")
    iv = clinical.load_extract(spark, "iv", str(tmp_path / "iv"), str(tmp_path / "notes"))
    iii = clinical.load_extract(spark, "iii", str(tmp_path / "iii"))
    assert set(iv) == set(iii)
    for name in iv:
        assert iv[name].dtypes == iii[name].dtypes, name
    assert rows(iv["admissions"], "hadm_id", "age", "los_days") == [(10, 63, 1.5), (20, 90, 2.0)]
    assert rows(iii["admissions"], "hadm_id", "age") == [(10, 59), (20, 90)]
    assert rows(iv["diagnoses"], "seq_num", "long_title") == [(1, "Heart failure"), (2, None)]
    assert rows(iv["labs"], "hadm_id", "valuenum", "label") == [(10, 1.5, "Glucose"), (None, None, "Glucose")]
    assert iii["icustays"].first().los is None
    assert rows(iii["notes"], "note_id", "charttime", "text") == [("1", dt.datetime(2100, 6, 1), 'line one\nsaid "ok", two')]
    assert rows(iv["notes"], "note_id", "charttime") == [("n1", dt.datetime(2103, 1, 2)), ("r1", None)]
    assert "notes" not in clinical.load_extract(spark, "iii", str(tmp_path / "iii"), demo=True)


def test_csv_errors_and_listing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_csv_any(spark, str(tmp_path), "missing")
    with pytest.raises(FileNotFoundError):
        files.read_optional_union(spark, str(tmp_path), ["a", "b"])
    with pytest.raises(ValueError):
        clinical.load_extract(spark, "v", str(tmp_path))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f.bin").write_bytes(b"12345")
    assert rows(files.list_files(spark, str(tmp_path)), "name", "size_bytes") == [("f.bin", 5)]
    assert files.preview(spark.range(20), ["id"], 5).count() == 5
