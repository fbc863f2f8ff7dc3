from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence


def brute(rows, least_docs=3, most=200):
    """Plain sums over dictionaries of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for _, _, t in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (lang, source, _), words in zip(rows, held, strict=True):
        df[lang].update(dict.fromkeys(words, 1))
        counts[lang, source] += words
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least_docs)

        def shares(words, kept=kept):
            total = sum(words[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (words[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda r: (r[0], r[1].encode()))[: None if part == "pair" else most]
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_documents_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(None, None, None, None, 0), (1, "", "en", None, 0), (1, "Ünique THE the", "xx", "s", 0), (2, " the'THE", None, "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd * 2, docs.schema)).withColumn("term", docs.doc_id).withColumn("counts", docs.text)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    found = divergence.divergences(docs.repartition(5))
    assert found.columns == COLUMNS and dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("most", [3, 200])
def test_ties_and_lists_longer_than_the_limit(spark, most):
    rng = np.random.default_rng(2)
    words = [f"{'abcdefgh'[i % 8]}{'xyzäö\U0001f600'[i % 6]}{'k' * (i // 8)}" for i in range(64)]
    rows = [("l" if i % 3 else "m", f"s{i % 4}", " ".join(rng.choice(words, 12))) for i in range(90)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert sorted(tuple(r) for r in divergence.divergences(docs, most=most).collect()) == brute(rows, most=most)


def test_spilled_stripes_merge_to_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)

    def seen(**bounds):
        rows = divergence.stripes(docs, **bounds).collect()
        return sorted((r.lang, r.term, r.n_docs, tuple(sorted(zip(r.sources, r.counts, strict=True)))) for r in rows)

    whole = seen()
    assert len(whole) == len({r[:2] for r in whole}) and whole == seen(most_terms=50, most_cells=200)


def test_many_rows_of_one_key(spark):
    docs = spark.range(3_000).selectExpr("'l' lang", "concat('s', id % 700) source", "'one two two' text").repartition(7)
    found = [tuple(r) for r in divergence.stripes(docs, most_terms=1).collect()]
    assert sorted((r[1], r[2], len(r[3]), sum(r[4])) for r in found) == [("one", 3_000, 700, 3_000), ("two", 3_000, 700, 6_000)]


def test_empty_tables_and_languages_without_terms(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergences(spark.createDataFrame([], schema)).count() == 0
    rows = [("l", "a", "x"), ("l", "b", None), ("l", "c", "y")]
    assert sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, schema)).collect()) == brute(rows)
    assert {r[4] for r in brute(rows)} == {0}


def test_share_is_exact():
    counts = np.array([0, 1, 5, 10**12, 3 * 10**15], np.int64)
    for total in (1, 7, 10**9, 4 * 10**15):
        assert divergence.share(counts[counts < total], np.int64(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist() if c < total]
