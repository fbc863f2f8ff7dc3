from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokenstore
from tidemark.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " ", "  ", "a", " a", "a  b", "a \n b", "a\n\n b c\t d ", " x   y", "don't I'll 'll <|endoftext|> x", "été 漢字 🙂 12 3.4",
         "x  y  z", " \n", "The the THE " * 50, "q" * 5_000, "a b\x00c \x85 d"]


def test_encoder_equals_the_library(spark, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encode = tokenstore.Encoder(PATH, keep=200)
    for some in ([t or "" for t in TEXTS], docs[:100], docs[100:], docs):
        assert [x.tolist() for x in encode(some)] == [library(t) for t in some]


def test_pieces_equal_the_library(library):
    rng = random.Random(4)
    some = ["".join(rng.choices("aZé×ǅɏɐαЖ҃1²Ⅷ'’.,_-`!ª\u0301\u00a0漢🙂\t\r\n\n    ", k=rng.randint(0, 40))) for _ in range(3_000)]
    some += ["".join(rng.choices(["it", "'s", "'ll", "x1", "é", ",", "...", "\n", "\n\n", " ", " "], k=rng.randint(0, 30))) for _ in range(3_000)]
    encode = tokenstore.Encoder(PATH, keep=500)
    assert [x.tolist() for first in range(0, 6_000, 500) for x in encode(some[first : first + 500])] == [library(t) for t in some]


def test_a_word_is_encoded_once_whatever_follows_it(library):
    encode = tokenstore.Encoder(PATH)
    asked, piece = [], encode._piece
    encode.inner.ask = encode._piece = lambda p: asked.append(p) or piece(p)
    text = "a zebrano zebrano, zebrano. zebrano,\nquagga zebrano.\nquagga quagga"
    assert encode([text])[0].tolist() == library(text)
    assert sorted(asked) == sorted([" zebrano", ",", ".", "\n", "quagga", " quagga"])


def test_random_access():
    rng = np.random.default_rng(1)
    documents = [rng.choice([0, 3, 255, 256, 50_256, 70_000, 2**31], int(n)).astype(np.uint32) for n in rng.integers(0, 900, 40)]
    raw = tokenstore.file_bytes([*range(39), None], documents)
    opened = tokenstore.TokenFile(lambda at, n: raw[at : at + n])
    ids = np.concatenate(documents)
    keys, starts = opened.documents()
    assert keys == [*range(39), None] and starts[-1] == len(ids) == opened.n_tokens
    assert opened.tokens(0, len(ids)).tolist() == ids.tolist()
    for at in rng.integers(0, len(ids), 200).tolist():
        assert opened.token(at) == ids[at]
        end = min(len(ids), at + int(rng.integers(0, 1_500)))
        assert opened.tokens(at, end).tolist() == ids[at:end].tolist()
    with pytest.raises(IndexError):
        opened.token(len(ids))
    empty = tokenstore.file_bytes([], [])
    assert tokenstore.TokenFile(lambda at, n: empty[at : at + n]).n_tokens == 0


def test_stored(spark, library):
    rows = [(i * 7 % 97, t, "f", 5) for i, t in enumerate(TEXTS * 2)] + [(None, "no key", "f", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, start int").repartition(4)
    found = sorted(tokenstore.stored(docs, PATH).collect(), key=lambda r: r.start)
    assert len(found) == len(rows)
    at, left = 0, sorted((r[0] is not None, r[0] or 0, len(library(r[1])) + 1, zlib.crc32(np.array([*library(r[1]), 0], "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == left
    for r, expected in zip(found, left, strict=True):
        assert r.start == at and (r.doc_id or 0) == expected[1]
        at += r.n_tokens


def test_several_files_and_empty_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = tokenstore.write(docs, PATH, scratch_path(spark, "files"), tokens=5_000)
    some = files.orderBy("start").collect()
    assert len(some) > 4 and [r.start for r in some[1:]] == np.cumsum([r.n_tokens for r in some])[:-1].tolist()
    found = {r.doc_id: r for r in tokenstore.read(files).collect()}
    for r in docs.collect():
        ids = np.array([*library(r.text), 0], dtype="<u4")
        assert (found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert tokenstore.stored(docs.limit(0), PATH).count() == 0


def test_added_tokens_as_the_untouched_library_has_them():
    untouched = Tokenizer.from_file(PATH)
    some = ["a <|endoftext|> b", "", "<|endoftext|>", "plain text", "x<|endoftext|><|endoftext|>\n y  <|endoftext|>", "<|endof text|> <| endoftext|>"]
    found = tokenstore.Encoder(PATH)(some)
    assert [f.tolist() for f in found] == [untouched.encode(t, add_special_tokens=False).ids for t in some]
    assert 50256 in found[0] and 50256 not in found[3]
