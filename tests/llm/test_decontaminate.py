from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def some(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for key, text in docs:
        words, hit, found = some(text), set(), set()
        for item, t in items:
            test = some(t)
            for at in range(max(len(test) - window + 1, 1) if test else 0):
                w = test[at : at + window]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def made():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Été", "a1", "b-2", "x", "yy", "zzz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(90, ""), (91, None), (92, "... !"), (93, items[3][1]), (7, "the")]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            test = rng.choice(items[:25])[1].split()
            text[5:5] = [w.upper() if rng.random() < 0.2 else w for w in test[: rng.randint(10, 30)]]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(text)))
    return docs + [(100, None), (101, ""), (102, docs[3][1]), (102, docs[3][1]), (None, docs[6][1]), (103, "of the " * 20_000)], items


def test_against_brute_force(spark):
    docs, items = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit("clash")).repartition(3)
    test = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    for block in (5_000, 7):
        found = decontaminate.contamination(frame, test, block=block).select(COLUMNS).collect()
        assert sorted(map(tuple, found), key=repr) == expected
    index = decontaminate.build(frame, tokens=100, gap=64)
    assert index.count() > 3
    split = decontaminate.search(index, test)
    assert sorted((r.row_key or -1, r.n_hit) for r in split.collect()) == sorted((e[0] or -1, e[2]) for e in expected)


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = decontaminate.contamination(docs, items).select(COLUMNS).collect()
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, found), key=repr) == brute(plain, [(r.item_id, r.text) for r in items.collect()])
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()}
    assert kept == {r.doc_id for r in found if not r.contaminated}


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta of the of the")], "item_id long, text string")
    rows = [(1, "x delta of x beta the alpha x gamma"), (2, "alpha beta gamma"), (3, "alpha " + "x " * 40 + "beta gamma delta of the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in decontaminate.contamination(docs, items, slop=10).collect()} == {1: 1, 2: 0, 3: 0}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(docs, items).collect()] == [False]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_words_inside_overlapping_spans(spark):
    spans = [[], None, [(3, 5)], [(8, 21), (0, 13), (2, 4), (30, 31)], [(5, 9), (5, 7), (9, 10)]]
    rows = spark.createDataFrame([*enumerate(spans)], "i int, spans array<struct<start: long, end: long>>")
    found = decontaminate._summed(rows)
    assert found.columns == ["i", "n_hit"] and [r.n_hit for r in found.orderBy("i").collect()] == [0, 0, 2, 22, 5]
