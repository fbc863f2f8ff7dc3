"""Token ids in files of directly addressable codes.

An id is split into bytes, low byte first. Level k of a file has the k-th byte of every id that needs one, and a
bitmap that says whether the id goes on; the place in the next level is the rank of its bit. A directory has the rank
at every 512th bit, so any token is read by one byte and one popcount per level, without decoding a block.

Documents are written in ascending key order, over as many files as tasks need; every file lists its documents.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import compile as pattern

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import scratch_path, staged
from .common import sliced, texts

MAGIC, LEVELS, BLOCK = b"DACTOK1\n", 4, 512
HEAD = struct.Struct("<8sqqi")
#: Bytes of the header: magic, documents, tokens, levels, then the number of entries of each level.
HEAD_SIZE = HEAD.size + 8 * LEVELS
BEFORE_WORD, ODD_SPACE = pattern(r"(?= \S)"), pattern(r" \s| $")
#: Letters that every Unicode version has as such, digits, marks without the apostrophe, a line end alone.
KINDS = r"[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωЀ-ҁҊ-ԯ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?!\n)"
PIECE, PLAIN = pattern(KINDS), pattern(rf"(?!\n)(?:{KINDS})+")


# ---------------------------------------------------------------- encoding


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: itself if it is visible, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}


class _Kept(dict):
    """Ids by word; those of a word that is not there are asked for."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.ask(word)
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, with the ids of recent words kept.

    A space before a visible character always begins a pre-token, so a text may be cut there and the parts encoded
    apart. A word of nothing but common letters, ASCII digits, punctuation and single line ends is cut on, where their
    kind changes, as the byte-level pre-tokenizer does; the library's model gets each such piece once, so a word costs
    little with its second mark. Other words go to the library as they are. Texts that hold an added token are encoded
    whole. Ids are kept as the bytes of unsigned 32-bit numbers; of the words, the last `keep` to twice `keep` stay.
    """

    def __init__(self, path: str, keep: int = 400_000):
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # for parts of texts without any added token, which cutting must not make up
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model, self.letters = self.library.model, _byte_letters()
        cuts = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer is not None else {}
        # cut further only where the pieces are known
        self.pieces = self.library.normalizer is None and cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]
        self.kept, self.older, self.inner = _Kept(self._word), {}, _Kept(self._piece)
        self.keep = keep

    def alone(self, some: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(some, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a single pre-token."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word and the space before it."""
        ids = self.older.get(word)
        if ids is not None:
            return ids
        if not self.pieces or not PLAIN.fullmatch(word):
            return self.alone([" " + word])[0]
        first, *rest = PIECE.findall(word)
        return self.kept[first] + b"".join([self.inner[p] for p in rest]) if rest else self._piece(" " + word)

    def __call__(self, some: list[str]) -> list[np.ndarray]:
        marked = [i for i, t in enumerate(some) if any(a in t for a in self.added)]
        if not marked:
            return self._plain(some)
        held = {*marked}
        out = dict(zip((i for i in range(len(some)) if i not in held), self._plain([t for i, t in enumerate(some) if i not in held]), strict=True))
        for i in marked:
            out[i] = np.array(self.whole.encode(some[i], add_special_tokens=False).ids, dtype=np.uint32)
        return [out[i] for i in range(len(some))]

    def _plain(self, some: list[str]) -> list[np.ndarray]:
        parts, firsts = [], []
        for text in some:
            if ODD_SPACE.search(text):
                cut = BEFORE_WORD.split(text)
                firsts.append(cut[0])
                parts.append([w[1:] for w in cut[1:]])
            else:
                cut = text.split(" ")
                firsts.append(cut[0])
                parts.append(cut[1:])
        if len(self.kept) > self.keep:
            self.older, self.kept = self.kept, _Kept(self._word)
        if len(self.inner) > self.keep:
            self.inner.clear()
        get = self.kept.__getitem__
        begun = self.alone(firsts)
        return [np.frombuffer(f + b"".join(map(get, p)), dtype=np.uint32) for f, p in zip(begun, parts, strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- the file format


def packed(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: bytes, continuation bits, and ranks at every block."""
    out, left = [], ids.astype(np.uint32)
    for _ in range(LEVELS):
        low, left = (left & 255).astype(np.uint8), left >> 8
        more = left > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        out.append((low, bits, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)))
        left = left[more]
    return out


def file_bytes(keys: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A file: header, keys, which keys are NULL, first token of every document, then the levels."""
    ids = np.concatenate(documents) if documents else np.empty(0, dtype=np.uint32)
    levels = packed(ids)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    null = np.array([k is None for k in keys], dtype=np.uint8)
    parts = [
        HEAD.pack(MAGIC, len(keys), len(ids), LEVELS) + struct.pack(f"<{LEVELS}q", *(len(low) for low, _, _ in levels)),
        np.array([k or 0 for k in keys], dtype=np.int64).tobytes(),
        null.tobytes(),
        starts.tobytes(),
    ]
    return b"".join([*parts, *(x.tobytes() for level in levels for x in level)])


class TokenFile:
    """Random access to the tokens of one file; `read(offset, size)` fetches bytes."""

    def __init__(self, read):
        self._read = read
        head = read(0, HEAD_SIZE)
        magic, self.n_docs, self.n_tokens, levels = HEAD.unpack(head[: HEAD.size])
        if magic != MAGIC or levels != LEVELS:
            raise ValueError("not a token file")
        sizes = struct.unpack(f"<{LEVELS}q", head[HEAD.size :])
        at = HEAD_SIZE
        self._keys = at
        at += 8 * self.n_docs + self.n_docs
        self._starts = at
        at += 8 * (self.n_docs + 1)
        self._levels = []
        for n in sizes:
            blocks = -(-n // BLOCK)
            self._levels.append((at, at + n, at + n + blocks * BLOCK // 8))
            at += n + blocks * BLOCK // 8 + 8 * (blocks + 1)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        keys = np.frombuffer(self._read(self._keys, 8 * self.n_docs), dtype=np.int64).tolist()
        null = self._read(self._keys + 8 * self.n_docs, self.n_docs)
        starts = np.frombuffer(self._read(self._starts, 8 * (self.n_docs + 1)), dtype=np.int64)
        return [None if z else k for k, z in zip(keys, null, strict=True)], starts

    def _rank(self, level: int, place: int) -> int:
        """Set bits before a place."""
        _, bits, ranks = self._levels[level]
        block, rest = divmod(place, BLOCK)
        before = int.from_bytes(self._read(ranks + 8 * block, 8), "little")
        if rest:
            some = np.frombuffer(self._read(bits + block * BLOCK // 8, -(-rest // 8)), dtype=np.uint8)
            before += int(np.unpackbits(some, bitorder="little")[:rest].sum())
        return before

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids from `start` to before `end`."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError(f"tokens {start} to {end} of {self.n_tokens}")
        out, going = np.zeros(end - start, dtype=np.uint32), np.arange(end - start)
        for k, (low, bits, _) in enumerate(self._levels):
            if start == end:
                break
            out[going] |= np.frombuffer(self._read(low + start, end - start), dtype=np.uint8).astype(np.uint32) << np.uint32(8 * k)
            first = start // 8
            some = np.frombuffer(self._read(bits + first, -(-end // 8) - first), dtype=np.uint8)
            more = np.unpackbits(some, bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            going = going[more]
            start = self._rank(k, start)
            end = start + len(going)
        return out

    def token(self, at: int) -> int:
        return int(self.tokens(at, at + 1)[0])


# ---------------------------------------------------------------- writing and reading


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> TokenFile:
    """A token file in any store that pyarrow opens; only the bytes asked for are read."""
    store, inner = _store(path)
    handle = store.open_input_file(inner)

    def read(offset: int, size: int) -> bytes:
        return handle.read_at(size, offset)

    return TokenFile(read)


def write(
    docs: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, tokens: int = 2_000_000
) -> DataFrame:
    """Writes all documents below `folder` and returns (file, start, n_tokens, n_docs) of every file, `start` being
    the number of tokens in all files before it.

    Documents are in ascending key order (NULL first), equal keys by text hash; each ends with `end_id`. Tasks write
    files of about `tokens` tokens under names of their own and report what they wrote, so a repeated task cannot
    mix with a lost one. Keys are integers.
    """
    rows = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    ordered = rows.repartitionByRange("row_key", "text_hash").sortWithinPartitions("row_key", "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        store, inner = _store(folder)
        store.create_dir(inner, recursive=True)
        keys: list[int | None] = []
        documents: list[np.ndarray] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{inner}/{name}") as out:
                out.write(file_bytes(keys, documents))
            made = {"file": [f"{folder}/{name}"], "part": [part], "number": [number], "n_tokens": [held], "n_docs": [len(keys)]}
            keys.clear()
            documents.clear()
            held, number = 0, number + 1
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), kinds, strict=True)], [*made])

        end = np.array([end_id], dtype=np.uint32)
        for batch in sliced(batches, "text", 4_000_000):
            for k, ids in zip(batch.column("row_key").to_pylist(), encode(texts(batch)), strict=True):
                keys.append(k)
                documents.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= tokens:
                    yield flush()
        if keys:
            yield flush()

    wrote = staged(ordered.mapInArrow(run, "file string, part int, number int, n_tokens long, n_docs long"), "token-files")
    # one small row per file
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return wrote.select("file", start.alias("start"), "n_tokens", "n_docs")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read token by token range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                opened = open_file(path)
                keys, starts = opened.documents()
                for i in range(0, len(keys), 512):
                    some = range(i, min(i + 512, len(keys)))
                    # one range per 512 documents, cut by their starts
                    base = int(starts[i])
                    ids = opened.tokens(base, int(starts[some.stop]))
                    parts = [ids[starts[d] - base : starts[d + 1] - base] for d in some]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(keys[i : some.stop], pa.int64()),
                            "start": pa.array(before + starts[i : some.stop]),
                            "n_tokens": pa.array([len(p) for p in parts], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                        }
                    )

    # a fixed number, since adaptive execution would put rows this small into one task
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("file", "start").repartition(parts, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents to the shared folder and returns what their files say.

    One row per input row: NULL and empty texts have the end id alone, repeated rows are stored as often as they
    occur, an empty table has no files.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer_path, folder, key, text)).withColumnRenamed("doc_id", key)
