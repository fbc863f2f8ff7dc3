from __future__ import annotations

import random
import re
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["a@b.c", "%d@e-f.g.h", "x@@y.z", "@q.r", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111",
              "+1 (555) 010-9999", "+1+2 345 678 901", "+49-", "é@x.y", " ", "-", ".", "12", "\n", "+", "(", "a", "٣", "4111111111111111"]
    for _ in range(4_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert sorted(pii.base_spans(text)) == sorted(brute(text)), text


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "a@" * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def weights():
    return pii.train(["the on of 12.5 and so", "mail bosbt.42@mail8.example.com now"])


def added(text, weights):
    known = {n: i for i, n in enumerate(weights)}
    return pii.added_spans(text, pii.base_spans(text), weights, known, np.array([*weights.values()]))


def test_rewritten_forms_are_found_and_decoys_left(weights):
    known, w = {n: i for i, n in enumerate(weights)}, np.array([*weights.values()])
    hit = missed = wrong = 0
    for text, spans in pii.examples([], seed=123, made=900):
        got = set(pii.added_spans(text, [], weights, known, w))
        hit, missed, wrong = hit + len(got & set(spans)), missed + len(set(spans) - got), wrong + len(got - set(spans))
    assert hit / (hit + missed) > 0.9 and wrong / (hit + wrong) < 0.1


def test_numbers_beside_each_other(weights):
    text = "and 4111111111111111 5500005555555559 on"
    assert pii.base_spans(text) == []
    assert sorted(added(text, weights)) == [("card", 4, 20), ("card", 21, 37)]


def test_dynamic_programme_against_all_segmentations(weights):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        segments = sorted(((i, j, k, np.array([0])) for i in range(n) for j in range(i + 1, n + 1) for k in range(2) if rng.random() < 0.4), key=lambda s: (s[1], s[0]))[:9]
        scores = rng.normal(size=len(segments))
        valid = []
        for size in range(len(segments) + 1):
            for chosen in combinations(range(len(segments)), size):
                spans = sorted(segments[c][:2] for c in chosen)
                if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                    valid.append((chosen, scores[list(chosen)].sum()))
        top = max(valid, key=lambda v: v[1])
        assert sorted(pii.best(n, segments, scores)) == sorted(segments[c][:3] for c in top[0])
        z, p = pii.marginals(n, segments, scores)
        assert z == pytest.approx(np.log(sum(np.exp(v) for _, v in valid)))
        for c in range(len(segments)):
            assert p[c] == pytest.approx(sum(np.exp(v) for chosen, v in valid if c in chosen) / np.exp(z))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(None, "x@y.zz", "a", "b", 1), (9000, None, "a", "b", 1), (9001, "", "a", "b", 1), (9001, "", "a", "b", 1), (9002, "é 10.0.0.1 " + "w " * 60_000 + "a@b.cc", "a", "b", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumnRenamed("lang", "spans")
    found = pii.find(docs)
    rows = found.collect()
    expected = sorted((str(r.doc_id), sha256(pii.joined(brute(r.text)).encode()).hexdigest(), *(sum(k == x for x, _, _ in brute(r.text)) for k in pii.KINDS)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows) == expected
    for r in rows:
        spans = [s for s in r.spans.split(",") if s]
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert pii.find(docs.limit(0)).count() == 0


def test_long_chains_and_long_addresses_are_whole(weights):
    one = "call (212) 555-0147 now, "
    text = one * 600
    assert len(pii.regions(text)) == 1
    found = added(text, weights)
    assert found and [f for f in found if f[1] < len(one)] != []
    shifted = {(k, a + n * len(one), b + n * len(one)) for k, a, b in added(one * 3, weights) if len(one) <= a < 2 * len(one) for n in range(-1, 598)}
    assert {f for f in found if f[1] < 599 * len(one)} >= shifted
    known = {name: i for i, name in enumerate(weights)}
    w = np.array([*weights.values()])
    tokens = pii.TOKEN.findall(text[:6_000])
    assert pii.segmented(tokens, known, w, 100) == pii.segmented(tokens, known, w, 10**6)
    long = "x" * 30 + "." + "y" * 30 + " (at) " + "z" * 60 + " (dot) org"
    assert pii.regions("see " + long) == [(2, len("see " + long))]
