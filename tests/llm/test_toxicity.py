from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import fold


def made(spark, n=600):
    rng = np.random.default_rng(3)
    words = [f"w{i}a" for i in range(150)]
    rows, marks = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, 40)]
        bad = int(i % 6 == 0)
        if bad:
            for at in rng.choice(40, 4, replace=False):
                text[at] = str(rng.choice(["vilest!", "Grubby", "zorkish", "zorked", "zorky"]))
        rows.append((i, " ".join(text), "en", 7))
        if i % 2 == 0:
            marks.append((i, 1, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, hits int")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i for i in range(n) if i % 6 == 0}


def test_finds_toxic_texts_of_the_held_out_fold(spark):
    docs, labels, bad = made(spark)
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == 600
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
    wrong = {r.doc_id for r in found if r.predicted} ^ bad
    assert len(wrong) <= 5


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs, labels, _ = made(spark, 300)
    flipped = labels.withColumn("toxic", F.when(fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    second = {r.doc_id: r.score for r in toxicity.classify(docs, flipped).collect()}
    assert first == pytest.approx(second)


def test_nulls_empty_texts_repeats_and_long_texts(spark):
    docs, labels, _ = made(spark, 300)
    odd = [(None, "vilest grubby zorked", None, 1), (900, None, None, 1), (901, "", "en", 1), (901, "", "en", 1), (902, "w1a " * 50_000, "x", 1)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (900, 1, None)], labels.schema))
    found = toxicity.classify(more, marks).collect()
    assert len(found) == 305
    empty = {r.score for r in found if r.doc_id in (900, 901)}
    assert len(empty) == 1 and empty.pop() < 0.3


def test_without_labels_or_documents(spark):
    docs, labels, _ = made(spark, 60)
    found = toxicity.classify(docs, labels.limit(0)).collect()
    assert len({r.score for r in found}) == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_forms():
    assert toxicity.forms(b"!!") == []
    assert toxicity.forms(b"trash,") == [b"trash", b"tras*"]
    assert toxicity.forms("größe".encode()) == ["größe".encode(), "größ".encode() + b"*"]


def test_every_mined_term_votes(spark):
    rng = np.random.default_rng(8)
    bad = [f"{a}{b}{c}x" for a in "bdgkm" for b in "ou" for c in "zvq"]
    texts = [" ".join(f"w{w}a" for w in rng.integers(0, 300, 20)) + (f" {bad[i // 4 % 30]}" if i % 4 == 0 else "") for i in range(2_400)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model, _ = toxicity.fit(docs, labels)
    leading = toxicity._leading(model.terms)
    assert len(leading) > 19 and model.voters == 3 * len(leading) + len(toxicity.PATTERNS) + 1
    assert all(any(i in leading for i, t in enumerate(model.terms) if t in toxicity.forms(b.encode())) for b in bad)
    # every term alone says toxic, whatever its rank
    assert {r.doc_id for r in toxicity.classify(docs, labels).collect() if r.predicted} == {*range(0, 2_400, 4)}


def test_only_implied_terms_do_not_vote():
    assert toxicity._leading((b"zork*", b"zorke*", b"zorked", b"zork", b"grub")) == [0, 3, 4]
