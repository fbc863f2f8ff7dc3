from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import linededup
from tidemark.llm.common import words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least=5):
    """Texts without the lines that repeat an earlier one or, from `least` words on, are within one edit of one."""
    seen, out = [], []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out.append((key, None, 0, 0))
            continue
        kept, n_exact, n_near = [], 0, 0
        for line in text.split("\n"):
            some = words(line)
            if some:
                same = any(some == s for s in seen)
                near = [s for s in seen if abs(len(s) - len(some)) < 2 and min(len(s), len(some)) >= least]
                close = not same and any(distance(some, s) <= 1 for s in near)
                if not same:
                    seen.append(some)
                n_exact, n_near = n_exact + same, n_near + close
                if same or close:
                    continue
            kept.append(line)
        out.append((key, "\n".join(kept), n_exact, n_near))
    return sorted(out, key=repr)


def made(n):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 9))] for _ in range(25)]

    def line():
        some = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(some))
            kind = rng.randrange(3)
            some[p : p + (kind != 0)] = [] if kind == 2 else [rng.choice(vocabulary)]
        return rng.choice([" ", "  ", "\t"]).join(w.upper() if rng.random() < 0.1 else w for w in some)

    return [(i, "\n".join(line() for _ in range(rng.randint(0, 5)))) for i in range(n)]


def test_against_all_pairs(spark):
    rows = [*made(80), (500, None), (501, ""), (502, "\n\n a b\n"), (None, "w1 w2 w3 w1 w2 w3 w1 w2"), (503, "x" * 50_000 + " 1 2 3 4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash")).withColumn("n", F.lit(1))
    found = linededup.dedup(docs)
    assert found.columns == ["doc_id", "text", "place", "n", "n_exact", "n_near"]
    got = sorted(((r.doc_id, r.text, r.n_exact, r.n_near) for r in found.collect()), key=repr)
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d e"), (1, "a b c d e\na b c d e"), (2, "a b x d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup(docs).collect()) == [(1, "a b c d e"), (1, "a b c d e"), (2, "")]
    assert linededup.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup(docs.withColumn("n_near", F.lit(0)))


def test_half_keys_and_verification():
    rng = random.Random(2)
    for _ in range(3_000):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 8))]
        b = list(a)
        p = rng.randrange(len(b))
        kind = rng.randrange(3)
        b[p : p + (kind != 0)] = [] if kind == 2 else [rng.choice([b"a", b"b", b"c"])]
        assert set(linededup.half_keys(a)) & set(linededup.half_keys(b))
        c = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(4, 7))]
        for x, y in ((a, b), (a, c), (b, c)):
            assert linededup.within_one_edit(x, y) == (distance(x, y) <= 1)


def test_short_lines_lose_exact_repeats_only(spark):
    rows = [(1, "Les.\na b c d\n\nonly"), (2, "les.\na b  C d\n\na b c x\nLes"), (3, "a b c d e\nonly\nLES."), (None, "Les.")]
    found = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_exact, r.n_near) for r in found} == {
        1: ("Les.\na b c d\n\nonly", 0, 0),
        2: ("\na b c x\nLes", 2, 0),
        3: ("a b c d e", 2, 0),
        None: ("", 1, 0),
    }
