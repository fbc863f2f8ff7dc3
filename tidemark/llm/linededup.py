"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of lower-cased words. Two lines match if they are equal or, from `min_words` words on, if
at most one word is inserted, deleted or replaced between them. Every such line emits itself and its variants with one word deleted as hashed keys; equal keys meet,
the words decide, and the earliest line stays.

A line can only match another if they share the words before or after their middle, so lines whose halves occur
nowhere else never emit their neighbourhood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged
from .common import list_array, sliced, words

#: The place of a line: documents in key order (NULL last), equal keys by text hash, then by line number.
PLACE = ("no_key", "row_key", "text_hash", "line_no")


def _hash(some: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(some))


def half_keys(some: list[bytes]) -> list[int]:
    """Keys of which two lines within one edit share at least one.

    Lines of n and of n or n - 1 words that differ by one edit agree, for the shorter length m, in the first m // 2 or
    in the last m - m // 2 words; each line emits both halves for m = n and m = n - 1.
    """
    out = []
    for m in (len(some), len(some) - 1):
        out.append(xxhash.xxh64_intdigest(b"%d<" % m + b" ".join(some[: m // 2])))
        out.append(xxhash.xxh64_intdigest(b"%d>" % m + b" ".join(some[len(some) - (m - m // 2) :])))
    return out


def neighbourhood(some: list[bytes]) -> list[tuple[int, int]]:
    """(hash, deleted position) of the line itself, with position -1, and of every line with one word fewer."""
    joined = b" ".join(some)
    out, at = [(xxhash.xxh64_intdigest(joined), -1)], 0
    for p, w in enumerate(some):
        rest = joined[: max(at - 1, 0)] + joined[at + len(w) :] if p else joined[len(w) + 1 :]
        out.append((xxhash.xxh64_intdigest(rest), p))
        at += len(w) + 1
    return out


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is inserted, deleted or replaced between two lines."""
    if abs(len(a) - len(b)) > 1:
        return False
    low = min(len(a), len(b))
    first = next((i for i in range(low) if a[i] != b[i]), low)
    if len(a) == len(b):
        return a[first + 1 :] == b[first + 1 :]
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[first:] == long[first + 1 :]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    column = F.col(key)
    return docs.select(column.isNull().alias("no_key"), column.alias("row_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """One row per line that is not blank: its place, two hashes and, from `min_words` words on, the keys of its halves."""
    places = [rows.schema[c] for c in PLACE[:3]]
    schema = StructType([*places, *StructType.fromDDL("line_no int, h1 long, h2 long, halves array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8_000_000):
            row, line, h1, h2, halves = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, one in enumerate((text or "").split("\n")):
                    some = words(one)
                    if some:
                        both = xxhash.xxh3_128_intdigest(b" ".join(some))
                        row.append(i)
                        line.append(n)
                        h1.append(both >> 64)
                        h2.append(both & 0xFFFFFFFFFFFFFFFF)
                        keys = half_keys(some) if len(some) >= min_words else []
                        halves.append(np.array(keys, dtype=np.uint64).view(np.int64))
            at = pa.array(row, pa.int64())
            hashes = [pa.array(np.array(h, dtype=np.uint64).view(np.int64), pa.int64()) for h in (h1, h2)]
            columns = [batch.column(c).take(at) for c in PLACE[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(line, pa.int32()), *hashes, list_array(halves, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def _variants(lines: DataFrame) -> DataFrame:
    """(h1, variant, gone) of every line in `line`."""
    schema = StructType.fromDDL("h1 long, variant long, gone int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "line", 100_000):
            found = [neighbourhood(words(t)) for t in batch.column("line").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            variant = np.array([h for f in found for h, _ in f], dtype=np.uint64).view(np.int64)
            gone = pa.array([p for f in found for _, p in f], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("h1").take(at), pa.array(variant, pa.int64()), gone], schema.names)

    return lines.select("h1", "line").mapInArrow(run, schema)


def _place() -> Column:
    return F.struct(*PLACE)


def _near(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(place): distinct lines with an earlier line within one edit."""
    halves = firsts.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    candidates = firsts.join(halves.join(shared, "half", "left_semi").select("h1").distinct(), "h1", "left_semi")
    candidates = candidates.select("h1", "place", *(F.col("place")[c].alias(c) for c in PLACE[1:]))
    texts = rows.join(candidates, [rows.row_key.eqNullSafe(candidates.row_key), rows.text_hash == candidates.text_hash])
    line = F.element_at(F.split("text", "\n", -1), F.col("line_no") + 1)
    texts = staged(texts.select("h1", "place", line.alias("line")).dropDuplicates(["place"]), "line-candidates")

    # a variant that only one line has connects nothing; the others get the place of their line
    variants = _variants(texts)
    busy = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("variant")
    variants = staged(variants.join(busy, "variant", "left_semi").join(texts.select("h1", "place"), "h1").drop("h1"), "line-variants")
    here = variants.groupBy("variant", "gone").agg(F.min("place").alias("low"))
    met = here.groupBy("variant").agg(F.min("low").alias("any"), F.min(F.when(F.col("gone") < 0, F.col("low"))).alias("whole"))
    # lines that lost the same word position differ in that word at most; a whole line is one word short of the others
    partner = F.when(F.col("gone") < 0, F.col("any")).otherwise(F.col("whole"))
    earlier = here.join(met, "variant").select("variant", "gone", F.array("low", partner).alias("earlier"))
    pairs = variants.join(earlier, ["variant", "gone"]).select("place", F.explode("earlier").alias("first"))
    pairs = pairs.filter(F.col("first") < F.col("place")).distinct()
    left = pairs.join(texts, "place").withColumnRenamed("line", "late")
    both = left.join(texts.select(F.col("place").alias("first"), "line"), "first")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            late, early = batch.column("late").to_pylist(), batch.column("line").to_pylist()
            good = [within_one_edit(words(a), words(b)) for a, b in zip(late, early, strict=True)]
            yield batch.select(["place"]).filter(pa.array(good, pa.bool_()))

    found = both.select("place", "late", "line").mapInArrow(verified, StructType([both.schema["place"]]))
    return found.distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """(no_key, row_key, text_hash, line_no, near): lines that an earlier line of the table repeats.

    `near` is false for exact repeats (after lower-casing A-Z and reducing white space) and true for lines one word
    edit away from an earlier one. Lines of fewer than `min_words` words have exact repeats only: with five, one edit
    leaves a similarity of at least 0.8.
    """
    rows = _rows(docs, key, text)
    lines = staged(_lines(rows, min_words), "lines")
    same = lines.groupBy("h1", "h2").agg(
        F.min(F.struct(_place().alias("place"), "halves")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    firsts = staged(same.select("h1", "h2", "first.place", "first.halves", "n"), "line-firsts")
    copies = lines.join(firsts.filter("n > 1").select("h1", "h2", "place"), ["h1", "h2"]).filter(_place() > F.col("place"))
    exact = copies.select(*PLACE, F.lit(False).alias("near"))
    return exact.unionByName(_near(rows, firsts).select("place.*", F.lit(True).alias("near")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """All rows and columns of `docs` with repeated lines taken out of the text, and `n_exact` and `n_near`, the
    number of lines taken out.

    The earliest line stays, in the order of keys (NULL last), text hashes and line numbers. Rows with equal key and
    equal text are one place and keep the same lines. Blank lines always stay; NULL
    texts stay NULL, and a text of which no line stays is empty.
    """
    taken = [c for c in ("n_exact", "n_near") if c in docs.columns]
    if taken:
        raise ValueError(f"columns {taken} are already there")
    drops = repeated_lines(docs, key, text, min_words).groupBy("row_key", "text_hash").agg(
        F.collect_set("line_no").alias("_drop"),
        F.count_if(~F.col("near")).alias("_exact"),
        F.count_if("near").alias("_near"),
    )
    drops = drops.select(F.col("row_key").alias("_key"), F.col("text_hash").alias("_hash"), "_drop", "_exact", "_near")
    joined = docs.join(drops, docs[key].eqNullSafe(drops["_key"]) & (F.xxhash64(docs[text]) == drops["_hash"]), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_drop", i)), "\n")
    return joined.select(
        *(F.when(F.col("_drop").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns),
        F.coalesce("_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
    )
