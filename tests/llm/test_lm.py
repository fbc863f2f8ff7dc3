from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm

END = None


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


class Plain:
    """The same model by its definition."""

    def __init__(self, docs, order):
        self.grams, self.order = Counter(), order
        for key, text in docs:
            if not held(key):
                some = [END, *tokens(text)]
                for i in range(1, len(some)):
                    for k in range(1, order + 1):
                        if i - k + 1 >= 0:
                            self.grams[tuple(some[i - k + 1 : i + 1])] += 1
        self.n = sum(c for g, c in self.grams.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.grams)

    def context(self, h):
        return self.grams[h]

    def p(self, w, h, mu):
        if not h:
            return (self.grams[(w,)] + 1) / (self.n + self.v + 1)
        return (self.grams[(*h, w)] + mu * self.p(w, h[1:], mu)) / (self.context(h) + mu)

    def score(self, text, mu):
        some = [END, *tokens(text)]
        return sum(math.log10(self.p(some[i], tuple(some[max(0, i - self.order + 1) : i]), mu)) for i in range(1, len(some)))


def made():
    rng = random.Random(2)
    follow = {f"w{i}": [f"w{rng.randrange(40)}" for _ in range(3)] for i in range(40)}
    docs = []
    for i in range(150):
        w, text = f"w{rng.randrange(40)}", []
        for _ in range(rng.randint(0, 40)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"x{rng.randrange(200)}"
            w = w if w in follow else rng.choice([w, "w1"])
            follow.setdefault(w, ["w1"])
        docs.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    return docs + [(200, None), (201, ""), (202, docs[1][1]), (202, docs[1][1]), (None, "w1 été"), (203, "w1 w2 " * 20_000)]


@pytest.mark.parametrize("order,block", [(1, 10**6), (2, 300), (3, 10**6), (3, 500)])
def test_against_the_definition(spark, order, block):
    docs = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(3)
    found = lm.score(frame, order=order, block_tokens=block, range_grams=400).collect()
    plain = Plain(docs, order)
    assert len(found) == len(docs) and len({r.mu for r in found}) == 1
    expected = {(k, t): plain.score(t, found[0].mu) for k, t in docs}
    by_key = {}
    for r in found:
        by_key.setdefault(r.doc_id, []).append(r)
    for (k, t), value in expected.items():
        for r in by_key[k]:
            some = tokens(t)
            base = sum(math.log10((plain.grams[(w,)] + 1) / (plain.n + plain.v + 1)) for w in some)
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held(k), len(some), plain.n)
            assert r.n_known == sum(plain.grams[(w,)] > 0 for w in some)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(value, rel=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(made(), 3)
    words = [g[0] for g in plain.grams if len(g) == 1]
    for h in [(), (END,), ("w1",), ("w1", "w2"), (END, "w3"), ("unseen",)]:
        assert sum(plain.p(w, h, 16.0) for w in [*words, "never"]) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    found = lm.score(spark.createDataFrame(made(), "doc_id long, text string")).filter("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40) if held(i)], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.score) for r in lm.score(docs).collect()} == {(0, 0, 0.0)}
    assert lm.score(docs.limit(0)).count() == 0


def test_packing():
    rng = np.random.default_rng(0)
    hashes = np.sort(rng.integers(0, 2**63, 500, dtype=np.uint64) * 2)
    assert (lm._unpack(lm._pack(hashes, 8), 8) == hashes).all()
    assert (lm._unpack(lm._pack(hashes, 6), 6) == hashes >> np.uint64(16) << np.uint64(16)).all()
    owners = lm._range_of(hashes, 7)
    assert (np.diff(owners) >= 0).all() and set(owners.tolist()) <= set(range(7))
    for most in (3, 300, 70_000, 2**33):
        values = rng.integers(0, most, 50)
        assert (lm._numbers(*lm._small(values)) == values).all()
