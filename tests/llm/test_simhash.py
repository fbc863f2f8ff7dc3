from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def plain_fingerprint(text):
    some = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not some:
        return 0
    shingles = [" ".join(some[i : i + 4]) for i in range(max(1, len(some) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, fps, distance):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(keys))]


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(None, "", "x", "y", 0), (9001, None, "x", "y", 0), (9002, " \n", "x", "y", 0), (9003, "One two", "x", "y", 0), (9003, "one TWO", "x", "y", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    expected = plain_components([r.doc_id for r in rows], fps, 4)
    found = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == sorted((str(r.doc_id), f"{f:016x}", c) for r, f, c in zip(rows, fps, expected, strict=True))


@pytest.mark.parametrize("block", [8, 4_096])
def test_clusters_and_hot_buckets_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(centres)
    for c in centres[:6]:
        for _ in range(60):
            x = c
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(classes, 4, block)
    for r in edges.collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [roots.get(f, f) for f in signed] == plain_components(signed, [f & ((1 << 64) - 1) for f in signed], 4)


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(5)
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_keep_first(spark):
    rows = [(5, "a b c d e", 1), (3, "A b C d e", 2), (3, "a b c d e", 1), (8, "", 3), (9, None, 4), (10, "quite another text here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = sorted(tuple(r) for r in simhash.keep_first(docs).collect())
    assert kept == [(3, "A b C d e", 2), (8, "", 3), (10, "quite another text here", 5)]
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_allocation_spends_the_whole_distance():
    costs = [[0, 5, 50, 500], [0, 1, 10, 100], [0, 2, 20, 200]]
    cost, thresholds = simhash.allocate(costs, 4)
    assert sum(t + 1 for t in thresholds) == 5
    assert cost == min(
        costs[0][a] + costs[1][b] + costs[2][c] for a in range(4) for b in range(4) for c in range(4) if a + b + c == 5
    )


def test_keep_first_of_null_and_repeated_keys(spark):
    rows = [
        (None, "the first of two unrelated texts", 1), (None, "quite another story about boats", 2), (None, "quite another story about boats", 1),
        (4, "one text under a shared id", 1), (4, "numbers of a wholly different kind", 1), (2, "numbers of a wholly different kind", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = sorted((tuple(r) for r in simhash.keep_first(docs).collect()), key=repr)
    assert kept == sorted([rows[0], rows[2], rows[3], rows[5]], key=repr)
