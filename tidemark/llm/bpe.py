"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, in parallel. Two scans of one
text that ever share a pre-token boundary agree from there on, so neighbouring chunks are stitched at the first
boundary both of them found inside the overlap. The pieces between stitches are encoded independently. Decoding
concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import list_array, sliced

#: Boundaries this close to the end of a chunk may depend on characters behind it: the longest fixed
#: alternative of the pattern has three characters, and a run of white space looks one character ahead.
MARGIN = 4
#: Ids that are decoded at a time.
DECODED = 1_000_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


@lru_cache(maxsize=4)
def _decimals(path: str) -> list[str]:
    return [str(i) for i in range(len(_vocabulary(path)))]


def boundaries(chunk: str, pattern: str, head: int, tail: int) -> tuple[list[int], list[int]]:
    """Starts of the pre-tokens inside the first `head` characters and from position `tail` on."""
    last = len(chunk) - MARGIN
    front, back = [], []
    for match in regex.compile(pattern).finditer(chunk):
        at = match.start()
        if at > last:
            break
        if 0 < at < head:
            front.append(at)
        if at >= tail:
            back.append(at)
    return front, back


def _chunks(longs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(text_key, part, parts, chunk) of texts longer than one chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = range(0, len(text), chunk)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "text_key": pa.array([key] * len(some), pa.string()),
                            "part": pa.array([s // chunk for s in some], pa.int32()),
                            "parts": pa.array([len(starts)] * len(some), pa.int32()),
                            "chunk": pa.array([text[s : s + chunk + overlap] for s in some], pa.string()),
                        }
                    )

    return longs.mapInArrow(cut, "text_key string, part int, parts int, chunk string")


def _pieces(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(text_key, part, parts, stitched, piece): the text between two stitches, or, where a seam of the text found no
    common boundary, the plain chunk without its overlap."""
    scanned_type = "text_key string, part int, parts int, chunk string, front array<int>, back array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], "chunk", 4_000_000):
                found = [boundaries(c, pattern, overlap, chunk) for c in batch.column("chunk").to_pylist()]
                front, back = (list_array([np.array(x[i], dtype=np.int32) for x in found], pa.int32()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, front, back], [*batch.schema.names, "front", "back"])

    text = Window.partitionBy("text_key")
    order = text.orderBy("part")
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    # positions inside the overlap, counted from the start of the next chunk
    shared = F.array_intersect(F.transform("back", lambda b: b - chunk), F.lead("front").over(order))
    seams = chunks.mapInArrow(scan, scanned_type).withColumn("cut", F.array_min(shared)).withColumn("from", F.lag("cut").over(order))
    seams = seams.withColumn("stitched", F.min(last | F.col("cut").isNotNull()).over(text.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    start = F.when(first | ~F.col("stitched"), 0).otherwise(F.col("from"))
    end = F.when(~F.col("stitched"), chunk).when(last, F.length("chunk")).otherwise(F.col("cut") + chunk)
    return seams.select("text_key", "part", "stitched", F.expr("chunk").substr(start + 1, end - start).alias("piece"))


def _ids(path: str, pattern: str, some: list[str | None]) -> list[np.ndarray]:
    encode = _encoder(path, pattern).encode_ordinary
    return [np.array(encode(t) if t else [], dtype=np.int32) for t in some]


def _with_ids(rows: DataFrame, column: str, path: str, pattern: str) -> DataFrame:
    """All other columns, and `ids` of the text in `column`. NULL counts as empty."""
    kept = [f for f in rows.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column, 4_000_000):
            ids = list_array(_ids(path, pattern, batch.column(column).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), ids], [*(f.name for f in kept), "ids"])

    return rows.mapInArrow(run, StructType([*kept, StructField("ids", ArrayType(IntegerType()))]))


def _long_ids(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row_key, ids) of texts longer than a chunk; equal texts are encoded once."""
    keyed = rows.withColumn("text_key", F.sha2(F.encode("text", "utf-8"), 256))
    distinct = keyed.select("text_key", "text").dropDuplicates(["text_key"])
    pieces = _pieces(_chunks(distinct, chunk, overlap).repartition("text_key", "part"), pattern, chunk, overlap)
    parts = _with_ids(pieces.withColumn("rest", F.when(~F.col("stitched"), F.col("piece"))).withColumn(
        "piece", F.when(F.col("stitched"), F.col("piece"))), "piece", path, pattern)
    listed = F.array_sort(F.collect_list(F.struct("part", "ids", "rest")))
    joined = parts.groupBy("text_key").agg(listed.alias("list")).select(
        "text_key",
        F.flatten(F.transform("list", lambda x: x["ids"])).alias("done"),
        F.array_join(F.transform("list", lambda x: x["rest"]), "").alias("rest"),
    )
    whole = _with_ids(joined, "rest", path, pattern).select("text_key", F.concat("done", "ids").alias("ids"))
    return keyed.select("row_key", "text_key").join(whole, "text_key").select("row_key", "ids")


def _split(docs: DataFrame, key: str, text: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(row_key, text) of the texts that fit into a chunk, and of the others."""
    if overlap <= 2 * MARGIN or chunk <= overlap:
        raise ValueError("a chunk has to be longer than the overlap, and the overlap longer than the margin")
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return rows.filter(~long), rows.filter(long)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    chunk_chars: int = 32_768,
    overlap_chars: int = 1_024,
) -> DataFrame:
    """(key, ids): the ids of every whole text, as encoding it in one go would give.

    One row per input row; repeated rows and equal keys stay apart, NULL and empty texts have an empty list, other
    columns are ignored. Texts of one chunk are encoded where they are. Longer ones are cut, stitched and encoded
    once per distinct text, so copies of a long text cost one encoding. A text with a seam at which no boundary
    resynchronises (a pre-token longer than the overlap) is put together again and encoded as a single piece.
    """
    short, long = _split(docs, key, text, chunk_chars, overlap_chars)
    ids = _with_ids(short, "text", ranks_path, pattern)
    return ids.unionByName(_long_ids(long, ranks_path, pattern, chunk_chars, overlap_chars)).withColumnRenamed("row_key", key)


def _bytes(path: str, ids: np.ndarray) -> bytes:
    return b"".join(map(_vocabulary(path).__getitem__, ids.tolist()))


def _rows_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """One numpy array per row of a list column, a row at a time; NULL gives an empty one."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[ends[i] : ends[i + 1]]


def _sliced_lists(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` list elements."""
    ends, start = batch.column(column).offsets.to_numpy(), 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """All columns and `decoded`: the raw bytes of the ids, concatenated. NULL ids decode to no bytes; an id outside
    the vocabulary fails the job."""
    schema = StructType([*tokens.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _sliced_lists(whole, ids, DECODED):
                raw = pa.array([_bytes(ranks_path, x) for x in _rows_of(batch.column(ids))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, ids: list[np.ndarray]) -> list[pa.Array]:
    """Token count, digest of the decimal ids and digest of the decoded bytes, per text."""
    decimal = _decimals(path)
    listed = [" ".join(map(decimal.__getitem__, x.tolist())).encode() for x in ids]
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha256(x).hexdigest() for x in listed], pa.string()),
        pa.array([sha256(_bytes(path, x)).hexdigest() for x in ids], pa.string()),
    ]


def round_trip(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    chunk_chars: int = 32_768,
    overlap_chars: int = 1_024,
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): `encode` followed by `decode`, of which only digests are kept.

    Ids and bytes of a text of one chunk never leave the Python worker.
    """
    short, long = _split(docs, key, text, chunk_chars, overlap_chars)
    schema = StructType([short.schema["row_key"], *StructType.fromDDL(DIGESTS).fields])

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2_000_000):
            ids = _ids(ranks_path, pattern, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), *_digests(ranks_path, ids)], schema.names)

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids in enumerate(_rows_of(batch.column("ids"))):
                yield pa.RecordBatch.from_arrays([batch.column("row_key").slice(i, 1), *_digests(ranks_path, [ids])], schema.names)

    longs = _long_ids(long, ranks_path, pattern, chunk_chars, overlap_chars)
    return short.mapInArrow(fused, schema).unionByName(longs.mapInArrow(stitched, schema)).withColumnRenamed("row_key", key)
