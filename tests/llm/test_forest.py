from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import forest


def plain_set(text, width=2):
    some = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    used = min(width, len(some))
    return {" ".join(some[i : i + used]) for i in range(len(some) - used + 1)} if some else set()


def brute(rows, percent=80):
    """(key, size, component, kept) by comparing all pairs of (key, text)."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    found = [(k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((k, n, c, k == c) for k, n, c in found), key=repr)


def seen(docs, **bounds):
    return sorted((tuple(r) for r in forest.near_duplicates(docs, **bounds).collect()), key=repr)


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [
        (None, "", "x", "y", 0), (9001, None, "x", "y", 0), (9002, " \n", "x", "y", 0), (9003, "One", "x", "y", 0), (9004, "one", "x", "y", 0),
        (9004, "ONE\ttwo", "x", "y", 0), (9005, "one two", "x", "y", 0), (9005, "a b c d e f g", "x", "y", 0), (9006, "a b c d e f", "x", "y", 0),
        (9007, "a b c d e f", "x", "y", 0), (9007, "a b c d e f", "x", "y", 0), (None, "lone text without a key", "x", "y", 0),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("id", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("n", F.lit(2))
    assert seen(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def changed(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("bounds", [{}, {"region": 8, "group": 20_000}])
def test_groups_and_chains_against_all_pairs(spark, bounds):
    """Large groups, chains of texts that only link to their neighbours, and pairs near the threshold."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n, share in ((90, 0.02), (60, 0.05), (40, 0.045), (12, 0.06)):
        centre = [rng.choice(words) for _ in range(120)]
        rows += [changed(rng, centre, share) for _ in range(n)]
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(40):
        chain = changed(rng, chain, 0.04)
        rows.append(chain)
    rows += [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(80)]
    rows = [(i * 7 % 1_000, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert seen(docs, **bounds) == brute(rows)


def test_recall_of_single_pairs_at_the_threshold(spark):
    """400 unrelated pairs of a similarity just above 0.8: no pair can be reached by way of another."""
    rows = []
    for i in range(400):
        words = [f"p{i}x{j}" for j in range(91)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:81], *(f"q{i}x{j}" for j in range(10))]))]
    assert 0.8 <= len(plain_set(rows[0][1]) & plain_set(rows[1][1])) / len(plain_set(rows[0][1]) | plain_set(rows[1][1])) < 0.81
    found = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in found) == 400


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(900).selectExpr("id doc_id", "if(id % 3 = 0, 'the same words in every copy', concat('text ', id, ' of its own ', id * 7)) text")
    found = forest.near_duplicates(docs.repartition(6)).collect()
    assert {r.component_id for r in found if r.doc_id % 3 == 0} == {0} and sum(r.kept for r in found) == 601


def test_empty_and_blank_tables(spark):
    schema = "doc_id long, text string"
    assert seen(spark.createDataFrame([], schema)) == []
    assert seen(spark.createDataFrame([(1, None), (2, " "), (2, "")], schema)) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_very_long_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5_000, 300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, " ".join(words[:100_000]))]
    assert [r[2] for r in seen(spark.createDataFrame(rows, "doc_id long, text string"))] == [1, 1, 3]


def test_minima_agree_as_often_as_sets():
    rng = np.random.default_rng(4)
    agreed = []
    for _ in range(30):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (800, 100, 100))
        one, two = (forest.minima(np.concatenate([common, x])) for x in (a, b))
        agreed.append((one == two).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.02
