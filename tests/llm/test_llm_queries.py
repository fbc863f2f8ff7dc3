"""Every registered query, and the pipeline, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import test_decontaminate
import test_linededup
import test_lm
import test_pii
import test_simhash
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidemark.llm import bpe, pii, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


def test_all_queries_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_op1(spark, docs):
    found = sorted((r.doc_id, r.text, r.n_exact, r.n_near) for r in run(spark, "op1_line_dedup"))
    assert found == sorted(test_linededup.brute(sorted(docs.items())))


def test_op2(spark, docs, library):
    found = run(spark, "op2_byte_bpe")
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_op4(spark, docs):
    plain = test_lm.Plain([*docs.items()], 2)
    for r in run(spark, "op4_lm_score"):
        some = test_lm.tokens(docs[r.doc_id])
        base = sum(math.log10((plain.grams[(w,)] + 1) / (plain.n + plain.v + 1)) for w in some)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(some), sum(plain.grams[(w,)] > 0 for w in some), plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain.score(docs[r.doc_id], r.mu), rel=1e-9)


def test_op5(spark, docs):
    for r in run(spark, "op5_pii"):
        assert r.base_sha256 == hashlib.sha256(pii.joined(test_pii.brute(docs[r.doc_id])).encode()).hexdigest()


def test_op7(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = [tuple(r[c] for c in test_decontaminate.COLUMNS) for r in run(spark, "op7_decontaminate")]
    assert sorted(found, key=repr) == test_decontaminate.brute([*docs.items()], items)


def test_op8(spark, docs):
    fps = {k: test_simhash.plain_fingerprint(t) for k, t in docs.items()}
    parts = dict(zip(fps, test_simhash.plain_components([*fps], [*fps.values()], 4), strict=True))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash")}
    assert found == {k: (f"{f:016x}", parts[k]) for k, f in fps.items()}


def test_op9(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, {}
    for k in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[k], add_special_tokens=False).ids, 0], dtype="<u4")
        expected[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op9_token_store")} == expected


def test_pipeline_stage_by_stage(spark, docs, library):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = frame.columns, [frame]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SMALL)
        path = corpus_pipeline.scratch_path(spark, "test-" + name.replace(" ", "-"))
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    texts = [{r.doc_id: r.text for r in f.collect()} for f in seen[:-1]]
    assert all(f.columns == columns for f in seen[:-1])

    rejected = {r.doc_id for r in queries.QUERIES["op10_toxicity"](spark, SMALL).collect() if r.predicted}
    assert texts[1] == {k: t for k, t in docs.items() if k not in rejected}
    assert texts[2] == {r[0]: r[1] for r in test_linededup.brute(sorted(texts[1].items()))}
    assert {r.doc_id: r.n_chars for r in seen[2].collect()} == {k: len(t) for k, t in texts[2].items()}
    fps = [test_simhash.plain_fingerprint(t) for t in texts[2].values()]
    first = set(test_simhash.plain_components([*texts[2]], fps, 4))
    assert texts[3] == {k: t for k, t in texts[2].items() if k in first}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {r[0] for r in test_decontaminate.brute([*texts[3].items()], items) if r[-1]}
    assert texts[4] == {k: t for k, t in texts[3].items() if k not in bad}
    assert {r.doc_id: (r.n_tokens, r.ids) for r in seen[5].collect()} == {
        k: (len(library.encode_ordinary(t)), library.encode_ordinary(t)) for k, t in texts[4].items()
    }


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "", "en", "s", 0), (2, "", None, None, None), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11)]
    for name, data in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        for table in ("labels", "benchmark"):
            some = spark.read.parquet(f"{SMALL}/{table}.parquet")
            (some if data else some.limit(0)).write.parquet(str(folder / f"{table}.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in found) == ([(1, 0), (3, 6)] if data else [])


def test_toxic_rows_take_no_others_of_their_id(spark, monkeypatch):
    rows = [(None, "clean one"), (None, "toxic"), (7, "clean two"), (7, "toxic"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verdict = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").eqNullSafe("toxic").cast("int").alias("predicted"))
    monkeypatch.setattr(corpus_pipeline.toxicity, "classify", lambda *_: verdict)
    left = corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()
    assert sorted((tuple(r) for r in left), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_pipeline_decodes_what_it_encodes(spark):
    rows = [(1, "one  two\nthree"), (2, ""), (3, None), (None, "größe 漢字 \U0001f600" * 3_000)]
    found = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in found} == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows}


def test_pipeline_tasks_have_one_python_worker(spark):
    """Python steps in a row of one task each keep a worker: their memory adds up."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for found in (corpus_pipeline.encode(spark, docs, SMALL), corpus_pipeline.decontaminate.contamination(docs, items)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
