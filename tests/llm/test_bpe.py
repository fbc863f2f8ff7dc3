from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None,
    "",
    " ",
    "one",
    "it's  we'll\n\n  they've 12345 ... naïve été  \t x",
    "word " * 700,
    "a" * 900,
    "   \n" * 300 + "end",
    "l'll 'll'll " * 200,
    "Ünïcödé 漢字かな🙂 " * 150,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def frame(spark, texts):
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, ids array<int>")


@pytest.mark.parametrize("chunk,overlap", [(64, 20), (257, 40), (100_000, 1_000)])
def test_equals_the_library(spark, library, chunk, overlap):
    docs = frame(spark, TEXTS + TEXTS)
    found = bpe.encode(docs, PATH, PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert len(found) == 2 * len(TEXTS)
    for row in found:
        assert row.ids == library.encode_ordinary((TEXTS + TEXTS)[row.doc_id] or "")


def test_round_trip_digests(spark, library):
    for row in bpe.round_trip(frame(spark, TEXTS), PATH, PATTERN, chunk_chars=128, overlap_chars=30).collect():
        text = TEXTS[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_keys_and_empty_table(spark, library):
    docs = spark.createDataFrame([(1, "x y " * 90), (1, "x y " * 90), (1, "z"), (None, "q")], "doc_id long, text string")
    found = bpe.encode(docs, PATH, PATTERN, chunk_chars=64, overlap_chars=20).collect()
    assert sorted(len(r.ids) for r in found) == sorted(len(library.encode_ordinary(t)) for t in ["x y " * 90] * 2 + ["z", "q"])
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


def test_decode(spark, library):
    ids = [library.encode_ordinary(t or "") for t in TEXTS]
    tokens = spark.createDataFrame([*enumerate(ids), (99, None)], "doc_id long, ids array<int>").repartition(3)
    found = {r.doc_id: bytes(r.decoded) for r in bpe.decode(tokens, PATH).collect()}
    assert found == {**{i: (t or "").encode() for i, t in enumerate(TEXTS)}, 99: b""}


def test_parameters():
    with pytest.raises(ValueError):
        bpe.encode(None, PATH, PATTERN, chunk_chars=10, overlap_chars=20)


def test_decoding_in_slices(spark, library, monkeypatch):
    ids = [library.encode_ordinary(t or "") for t in TEXTS]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([*ids, None, []], pa.list_(pa.int32()))})
    for most in (1, 50, 10_000):
        for part in (batch, batch.slice(3)):
            slices = [*bpe._sliced_lists(part, "ids", most)]
            assert [x for s in slices for x in s.column("ids").to_pylist()] == part.column("ids").to_pylist()
            assert all(len(s) == 1 or sum(len(x or []) for x in s.column("ids").to_pylist()) <= most for s in slices)
    assert [*bpe._sliced_lists(batch.slice(0, 0), "ids", 1)] == []
