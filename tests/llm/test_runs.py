from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import runs


def brute(words):
    """Every maximal stretch by trying all periods."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_joined_texts_against_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(25):
        some = []
        for _ in range(rng.randint(1, 5)):
            words = []
            while len(words) < rng.randint(0, 400):
                period = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 64])
                base = [rng.randint(0, rng.choice([1, 2, 3, 50])) for _ in range(period)]
                words += (base * 9)[: rng.randint(1, period * 6)] + [rng.randint(0, 9) for _ in range(rng.randint(0, 3))]
            some.append(words)
        joined, expected = [], []
        for i, words in enumerate(some):
            expected += [(s + len(joined), s + len(joined) + n, q) for s, n, q in brute(words)]
            joined += [*words, -1 - i]
        lengths = np.array([len(w) for w in some], np.int64)
        assert runs.runs(np.array(joined, np.int64), lengths) == sorted(expected)


@pytest.mark.parametrize("length", [5, 6, 7, 8, 19, 20, 21, 31, 32, 33])
def test_least_lengths(length):
    for q in range(1, 9):
        words = [f"w{i % q}" for i in range(length)]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = runs.runs(np.array([*(numbers[w] for w in words), -1], np.int64), np.array([length]))
        assert found == ([(0, length, q)] if length >= max(6, 4 * q) else [])


def test_rows(spark):
    odd = [
        (1, "a b a b a b a b c", 1), (1, "a b a b a b a b c", 1), (None, " x\tx\nx x x x ", 2), (2, None, 3), (3, "", 4), (4, " \n ", 5),
        (5, "A a A a a A a A a  a  a", 6), (6, "x " * 5, 7), (7, "eins zwei drei " * 4 + "eins", 8),
    ]
    docs = spark.createDataFrame(odd, "doc_id long, text string, runs int").repartition(3)
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in runs.find(docs).collect()), key=repr)
    expected = []
    for key, text, _ in odd:
        words = [w.decode() for w in (text or "").encode().split()]
        expected.append((key, brute(words), collapsed(words, brute(words)), len(words)))
    assert found == sorted(expected, key=repr)
    assert runs.digests(runs.find(docs.limit(0))).count() == 0


def test_query_against_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    frame = frame.unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate([None, "", "one", "one two", "a b c"] * 12)], frame.schema))
    docs = {r.doc_id: r.text for r in frame.collect()}
    found = {r.doc_id: tuple(r)[1:] for r in runs.digests(runs.find(runs.planted(frame))).collect()}
    n_planted = 0
    for key, text in docs.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(key).encode()), len(words)
        if h % 10 == 0 and n:
            g, n_planted = h // 10, n_planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        some = brute(words)
        best = min(some, key=lambda r: (-r[1], r[0], r[2]), default=None)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in some)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, some))]
        assert found.pop(key) == (len(some), *head, *digests)
    assert not found and n_planted > 10


def test_long_texts_take_linear_time():
    rng = np.random.default_rng(1)
    took = []
    for n in (100_000, 400_000):
        words = np.concatenate([rng.integers(0, 50, n // 4), np.tile(rng.integers(0, 9, 300), n // 600), np.zeros(n // 4, np.int64), [-1]])
        start = time.perf_counter()
        found = runs.runs(words, np.array([len(words) - 1]))
        took.append(time.perf_counter() - start)
        assert len(found) >= 2
    assert took[1] < 12 * max(took[0], 0.05)
