"""Indexes, sketches, saved detection state, versions, commit records and sealed logs."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import additive, retrieval, sketches, trigrams, vector_index
from tidemark.operators.filters import search_any
from tidemark.plans import monitoring, monitoring_resume
from tidemark.session import scratch_path
from tidemark.sources import commits, published, sealed

# ---------------------------------------------------------------- vectors


def _vectors(spark, n=600, size=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, size))
    rows = [(i, (centres[i % 15] + 0.3 * rng.normal(size=size)).astype(float).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * size), (n + 2, rows[0][1]), (n + 3, [2 * x for x in rows[0][1]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_exact_search_by_lists_equals_the_scan(spark):
    docs = _vectors(spark)
    queries = docs.where("vec_id % 20 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(docs, "vec_id", "embedding", scratch_path(spark, "index"))
    assert index.sizes.sum() == 603 and len(index.numbers) <= 24
    found = vector_index.search(index, queries, 5, probes=1, exact=True)
    expected = retrieval.top_k_similar(docs, "vec_id", "embedding", queries, 5)

    def plain(df):
        return sorted((r.query_id, r.rank, r.vec_id, None if r.score is None else round(r.score, 9)) for r in df.collect())

    assert plain(found.rows) == plain(expected)
    read = found.scanned.collect()
    assert len(read) == queries.count() and min(r.lists for r in read) < len(index.numbers)


def test_copies_rank_by_key(spark):
    """A product of matrices gives copies scores that differ in the last digit; copies rank by key all the same."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64)).astype(np.float32).astype(float)
    copies = [(i + 300 * c, base[i].tolist()) for c in range(7) for i in range(300)]
    docs = spark.createDataFrame(copies, "vec_id long, embedding array<double>").repartition(5, "vec_id")
    index = vector_index.build(docs, "vec_id", "embedding", scratch_path(spark, "index"), lists=6)
    found = vector_index.search(index, [(i, base[i].tolist()) for i in range(0, 300, 3)], 7, probes=1, exact=True)
    ranked = {}
    for r in found.rows.orderBy("query_id", "rank").collect():
        ranked.setdefault(r.query_id, []).append(r.vec_id)
    assert ranked == {i: [i + 300 * c for c in range(7)] for i in range(0, 300, 3)}


def test_recall_grows_with_probes(spark):
    docs = _vectors(spark)
    queries = docs.where("vec_id % 20 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(docs, "vec_id", "embedding", scratch_path(spark, "index"), lists=15)
    exact = retrieval.top_k_similar(docs, "vec_id", "embedding", queries, 5)
    shares = [vector_index.recall(vector_index.search(index, queries, 5, probes=p).rows, exact, "vec_id").first().recall for p in (1, 15)]
    assert shares[0] >= 0.8 and shares[0] <= shares[1] and shares[1] >= 0.95


def test_few_rows_and_rows_without_direction(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    index = vector_index.build(docs, "vec_id", "embedding", scratch_path(spark, "index"))
    rows = vector_index.search(index, [(7, [1.0, 1.0])], 5, exact=True).rows.orderBy("rank").collect()
    assert [(r.vec_id, r.score is None) for r in rows] == [(1, False), (2, True)]
    empty = vector_index.build(docs.limit(0), "vec_id", "embedding", scratch_path(spark, "index"))
    assert vector_index.search(empty, [(7, [1.0, 1.0])], 5, exact=True).rows.count() == 0


# ---------------------------------------------------------------- additive model


@pytest.mark.parametrize(("bends", "order"), [(0, 0), (3, 3)])
def test_additive_model_equals_a_plain_regression(spark, bends, order):
    rng = random.Random(1)
    start, rows = date(2024, 1, 3), []
    for key in range(5):
        for d in range(90):
            if rng.random() < 0.8:
                units = max(0, int(5 + key * d / 30 + 4 * ((d + 3) % 7 == 5) + rng.gauss(0, 1) - (key == 4) * d / 12))
                rows.append((key, key + 100, start + timedelta(days=d), units))
    rows.append((9, 9, start, 7))
    history = spark.createDataFrame(rows, "store_id int, product_id int, sale_date date, units_sold int")
    found = {r.store_id: (r.forecast_30d_units, r.confidence) for r in additive.forecast_additive(history, bends=bends, order=order).collect()}
    for key in range(5):
        own = [(d, u) for k, _, d, u in rows if k == key]
        first, last = min(d for d, _ in own), max(d for d, _ in own)
        span = (last - first).days

        def regressors(d, first=first, span=span):
            at, w = (d - first).days / span, 2 * np.pi / 7 * d.weekday()
            hinges = [max(0.0, at - 0.8 * (i + 1) / (bends + 1)) for i in range(bends)]
            return [1.0, at, *hinges, *(f(i * w) for i in range(1, order + 1) for f in (np.sin, np.cos))]

        x, y = np.array([regressors(d) for d, _ in own]), np.array([u for _, u in own], float)
        penalty = np.sqrt(np.array([0.0, 0.0, *[10.0] * bends, *[1.0] * (2 * order)]))
        beta = np.linalg.lstsq(np.vstack([x, np.diag(penalty)]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
        ahead = sum(max(0.0, float(np.dot(regressors(last + timedelta(days=h)), beta))) for h in range(1, 31))
        assert found[key][0] == pytest.approx(ahead, abs=0.06) and found[key][1] == ("high" if len(own) >= 60 else "medium")
    assert found[9] == (210.0, "low")


# ---------------------------------------------------------------- detection state


def test_runs_over_parts_equal_one_run(spark):
    rng = random.Random(5)
    start, rows = datetime(2024, 1, 1), []
    for i in range(900):
        kind = rng.choice(["CASH_DEPOSIT", "WIRE_IN", "WIRE_OUT", "ACH_OUT"])
        at = start + timedelta(hours=rng.choice([rng.randint(0, 900), rng.randint(2_600, 3_000)]))
        rows.append((rng.randint(1, 12), i, at, kind, rng.choice([850_000, 500_000, 2_500_000, 700_000, 123_456]), rng.choice(["US", "US", "IR"])))
    txns = spark.createDataFrame(rows, monitoring_resume.TXN)
    rules = monitoring_resume.standard_rules(gap="40 days")
    expected = monitoring.run_rules(txns) | {"DORMANT_REACTIVATION": monitoring.dormant_reactivation(txns, gap="40 days")}
    detector = monitoring_resume.Detector(spark, scratch_path(spark, "detector"), rules)
    cuts = [start + timedelta(hours=h) for h in (0, 400, 2_700, 4_000)]
    given = {r.rule_id: [] for r in rules}
    for run, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = txns.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        for _ in range(2 if run == 1 else 1):  # a repeated run replaces itself
            detector.advance(run, {r.rule_id: part for r in rules})
        for rule, h in detector.hits(run).items():
            given[rule] += [r.txn_id for r in h.evidence.collect()]
    for rule, h in detector.hits(run).items():
        columns = ["customer_id", "total_cents", "first_ts", "last_ts", "n_evidence"]
        found, wanted = (sorted(tuple(r) for r in x.select(*columns).collect()) for x in (h.summary, expected[rule].summary))
        assert found and found == wanted, rule
        assert sorted(given[rule]) == sorted(r.txn_id for r in expected[rule].evidence.collect()), rule
    kept = spark.read.parquet(f"{detector.path}/run={run}/STRUCTURING/kept")
    assert kept.agg(F.min("ts")).first()[0] >= max(r[2] for r in rows if r[3] == "CASH_DEPOSIT" and r[4] == 850_000) - timedelta(days=7)


# ---------------------------------------------------------------- versions, commits, seals

COPY = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])


def test_publishing_writes_what_changed(spark):
    copy = published.PublishedCopy(spark, scratch_path(spark, "copy"), COPY, ["id"], buckets=4)
    versions = [
        [(i, f"row {i}", i) for i in range(50)],
        [(i, f"row {i}" if i % 10 else "new", i if i != 7 else None) for i in range(5, 60)],
        [(i, f"row {i}" if i % 10 else "new", i if i != 7 else None) for i in range(5, 60)],
        [],
        [(None, None, None), (3, "back", 1)],
    ]
    old, seen = {}, []
    for rows in versions:
        changes = copy.publish(spark.createDataFrame(rows, COPY))
        new = {r[0]: r for r in rows}
        kinds = sorted((r.id is None, r.id or 0, r.operation) for r in changes.collect())
        expected = [(k, "insert" if k not in old else "update") for k in new if old.get(k) != new[k]] + [(k, "delete") for k in old if k not in new]
        assert kinds == sorted((k is None, k or 0, o) for k, o in expected)
        assert sorted(map(repr, (tuple(r) for r in copy.current().collect()))) == sorted(map(repr, rows))
        seen.append(len(kinds))
        old = new
    assert seen[2] == 0 and copy._next() == 4  # nothing changed: no version


def test_a_broken_batch_is_invisible(spark, monkeypatch):
    schemas = {"a": "id long, x string", "b": "id long, y long"}
    store = commits.CommittedTables(spark, scratch_path(spark, "commits"), schemas)
    assert store.read("a").count() == 0 and not store.committed("one")

    def outputs(i):
        return {"a": spark.createDataFrame([(i, "x"), (i + 1, "y")], schemas["a"]), "b": spark.createDataFrame([(i, i)], schemas["b"])}

    store.write("one", outputs(1))
    real = store._put
    for broken in ("a", "b", "record"):

        def put(name, batch, attempt, rows, broken=broken):
            if name == broken:
                raise OSError("lost")
            real(name, batch, attempt, rows)

        def commit(*_):
            raise OSError("lost")

        monkeypatch.setattr(store, "_put", put)
        if broken == "record":
            monkeypatch.setattr(store, "_commit", commit)
        with pytest.raises(OSError):
            store.write("two", outputs(10))
        assert store.read("a").count() == 2 and store.read("b").count() == 1
    monkeypatch.undo()
    store.write("two", outputs(10))
    store.write("two", outputs(99))
    assert sorted(r.id for r in store.read("a").collect()) == [1, 2, 10, 11] and sorted(r.id for r in store.read("b").collect()) == [1, 10]
    assert store.repair() == 3  # broken at b left table a, at the record both
    assert sorted(r.id for r in store.read("a").collect()) == [1, 2, 10, 11]
    with pytest.raises(ValueError):
        store.write("three", {"a": store.read("a")})


def _sealed(spark):
    log = sealed.SealedLog(spark, scratch_path(spark, "log"), "id long, note string")
    for i in range(3):
        log.append(spark.createDataFrame([(10 * i + j, f"note {j}") for j in range(4)], "id long, note string").repartition(2))
    return log


def test_sealed_log_reads_back_and_refuses_other_columns(spark):
    log = _sealed(spark)
    log.check()
    assert sorted(r.id for r in log.read().collect()) == [10 * i + j for i in range(3) for j in range(4)]
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([(1,)], "id long"))


@pytest.mark.parametrize("how", ["changed", "missing", "added", "seal"])
def test_sealed_log_notices_a_changed_past(spark, how):
    log = _sealed(spark)
    folder = f"{log.path}/rows/append=1"
    if how == "changed":
        rows = spark.createDataFrame([(10 + j, "other") for j in range(4)], "id long, note string")
        rows.repartition(2).write.mode("overwrite").parquet(folder)
    elif how == "missing":
        spark.createDataFrame([], "id long, note string").write.mode("overwrite").parquet(folder)
    elif how == "added":
        spark.createDataFrame([(99, "x")], "id long, note string").write.mode("append").parquet(folder)
    else:
        seals = [tuple(r) for r in log._seals().collect()]
        forged = spark.createDataFrame([(n, b, s if n != 1 else "0" * 64) for n, b, s in seals], sealed.SEALS)
        forged.coalesce(1).write.mode("overwrite").parquet(f"{log.path}/seals")
    with pytest.raises(sealed.LogChanged):
        log.append(spark.createDataFrame([(5, "x")], "id long, note string"))
    if how != "seal":
        assert log.problems().where("append <> 1").count() == 0


# ---------------------------------------------------------------- sketches, trigrams


def test_merged_sketches_stay_within_the_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 7 % 25_000).alias("who"))
    daily = sketches.distinct_sketches(rows, ["day"], {"who": "who"})
    merged = sketches.estimates(sketches.merge_sketches(daily, [(F.col("day") >= 15).alias("half")], ["who"]), ["who"])
    exact = {r.half: r.who for r in sketches.distinct_counts(rows, [(F.col("day") >= 15).alias("half")], {"who": "who"}).collect()}
    for r in merged.collect():
        assert abs(r.who - exact[r.half]) <= 3 * sketches.relative_error() * exact[r.half]
    close = sketches.distinct_counts(rows, ["day"], {"who": "who"}, exact=False).where("day = 3").first().who
    assert abs(close - 2_000) <= 3 * sketches.relative_error() * 2_000 + 1


def test_trigram_search_reads_fewer_parts(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    rows = [(i, f"{words[i % 400].title()} item", words[(i * 13) % 400] if i % 5 else None, i % 3) for i in range(1_200)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, size int")
    path, columns = scratch_path(spark, "trigrams"), ["name", "kind"]
    trigrams.build(df, columns, path, parts=24)
    for text in (words[5], words[77][1:5].upper(), " ITEM ", "ab", "", None, "zzzz", "100%"):
        hits = trigrams.search(spark, path, columns, text, {"size": [0, 2]})
        expected = search_any(df, columns, text, {"size": [0, 2]})
        assert sorted(r.id for r in hits.rows.select(*df.columns).collect()) == sorted(r.id for r in expected.collect())
        assert hits.parts_read <= hits.parts
    assert trigrams.search(spark, path, ["name"], words[5]).parts_read <= 3
    assert trigrams.search(spark, path, columns, "zzzz").parts_read == 0
