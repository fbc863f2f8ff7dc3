"""Small pieces that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract here defines them (ASCII white space separates).
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: A-Z to a-z on UTF-8 bytes; bytes of longer characters stay as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo the number of parts; a NULL key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes; bytes.split() separates at exactly x20 and x09-x0D."""
    return text.encode().translate(LOWER).split() if text else []


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; NULL counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `chars` bytes of text, so that memory per batch is bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(sizes) > start:
            yield batch.slice(start, len(sizes) - start)
