"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by document: each row is a shard with the postings of every term of its documents, so terms of
one text are always intersected inside one row and no posting is ever shuffled. A test phrase starts from the postings
of its rarest terms, shifted by their offsets in the phrase, and is intersected term by term in order of rarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import staged

#: Lower-cases A-Z, keeps digits, letters and all bytes of longer characters, and separates at everything else.
TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SHARD = "text_hashes array<long>, starts array<long>, sizes array<long>, terms binary, counts binary, postings binary"
#: Of a window, so many of its rarest terms have to be near each other for a proximity match.
RARE = 4


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERMS).split() if text else []


def hashed(some) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in some], dtype=np.uint64)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = 64, tokens: int = 800_000) -> DataFrame:
    """The index: one row per shard of about `tokens` words of whole documents, every document in exactly one.

    A shard has the keys, text hashes, first positions and word counts of its documents, and per term, in order of
    its hash, the number of postings and the postings: positions in the shard. `gap` positions separate documents.
    """
    rows = docs.select(F.col(key).alias("row_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    keys = rows.schema["row_key"]
    schema = StructType([StructField("row_keys", ArrayType(keys.dataType)), *StructType.fromDDL(SHARD).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words: list[bytes] = []

        def shard() -> pa.RecordBatch:
            known = dict.fromkeys(words)
            for i, w in enumerate(known):
                known[w] = i
            ids = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
            hashes = hashed(known)
            order = np.argsort(hashes)
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            sizes = np.array([n for _, _, n in held], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            places = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
            ranks = rank[ids]
            # one sort of (term, place) packed into a number
            postings = np.sort(ranks.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64)) & np.uint64(0xFFFFFFFF)
            values = [
                [k for k, _, _ in held],
                [h for _, h, _ in held],
                starts.tolist(),
                sizes.tolist(),
                hashes[order].tobytes(),
                np.bincount(ranks, minlength=len(order)).astype(np.uint32).tobytes(),
                postings.astype(np.uint32).tobytes(),
            ]
            held.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], schema.names)

        kinds = None
        for batch in batches:
            if kinds is None:
                whole = pa.int64()
                kinds = [pa.list_(batch.schema.field("row_key").type), *[pa.list_(whole)] * 3, *[pa.binary()] * 3]
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                for k, h, t in zip(*(part.column(c).to_pylist() for c in ("row_key", "text_hash", "text")), strict=True):
                    found = terms(t)
                    words += found
                    held.append((k, h, len(found)))
                    if len(words) >= tokens:
                        yield shard()
        if held:
            yield shard()

    return rows.mapInArrow(run, schema)


@dataclass
class Shard:
    """One row of the index, unpacked."""

    starts: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    postings: np.ndarray

    @staticmethod
    def of(row: dict) -> Shard:
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], dtype=np.uint32), dtype=np.int64)])
        return Shard(
            np.array(row["starts"], dtype=np.int64),
            np.array(row["sizes"], dtype=np.int64),
            np.frombuffer(row["terms"], dtype=np.uint64),
            ends,
            np.frombuffer(row["postings"], dtype=np.uint32),
        )

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term in this shard; -1 where it does not occur."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(len(hashes), -1)

    def list(self, number: int) -> np.ndarray:
        return self.postings[self.ends[number] : self.ends[number + 1]].astype(np.int64)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


@dataclass
class Phrases:
    """Windows of test items: for every window its item, and its term numbers in phrase order."""

    item: np.ndarray
    words: list[np.ndarray]
    hashes: np.ndarray


def phrases(items: list[tuple], window: int) -> Phrases:
    """All windows of `window` consecutive words; an item of fewer words, but not none, is one window."""
    known: dict[bytes, int] = {}
    owner, found = [], []
    for i, (_, text) in enumerate(items):
        numbers = np.array([known.setdefault(t, len(known)) for t in terms(text)], dtype=np.int64)
        for at in range(max(len(numbers) - window + 1, 1) if len(numbers) else 0):
            owner.append(i)
            found.append(numbers[at : at + window])
    return Phrases(np.array(owner, dtype=np.int64), found, hashed(known))


def _in(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == wanted


def exact(shard: Shard, words: np.ndarray, here: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Positions at which the phrase starts: offset-adjusted lists, intersected from the rarest term on."""
    first = order[0]
    places = shard.list(here[words[first]]) - first
    for offset in order[1:]:
        if not len(places):
            break
        places = places[_in(shard.list(here[words[offset]]), places + offset)]
    return places


def near(shard: Shard, rare: list[int], slop: int) -> np.ndarray:
    """Places of the rarest term that have the other terms within `slop` words in the same document."""
    places = shard.list(rare[0])
    for word in rare[1:]:
        if not len(places):
            break
        doc = shard.document(places)
        low = np.maximum(places - slop, shard.starts[doc])
        high = np.minimum(places + slop, shard.starts[doc] + shard.sizes[doc] - 1)
        other = shard.list(word)
        places = places[np.searchsorted(other, low) < np.searchsorted(other, high, side="right")]
    return places


def _term_counts(index: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """How often each of the given terms occurs in the whole index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), dtype=np.int64)
        for batch in batches:
            for t, c in zip(batch.column("terms"), batch.column("counts"), strict=True):
                some, n = np.frombuffer(t.as_py(), dtype=np.uint64), np.frombuffer(c.as_py(), dtype=np.uint32)
                if len(some):
                    at = np.searchsorted(some, hashes)
                    at[at == len(some)] = 0
                    total += np.where(some[at] == hashes, n[at], 0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "n": pa.array(total)})

    out = np.zeros(len(hashes), dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out


def _block(index: DataFrame, items: list[tuple], window: int, slop: int) -> DataFrame:
    """(row_key, text_hash, n_words, spans, items, near) of every document against one block of test items."""
    test = phrases(items, window)
    frequency = _term_counts(index, test.hashes)
    orders = [np.argsort(frequency[w], kind="stable") for w in test.words]
    rarest = [np.array([*dict.fromkeys(w[o].tolist())][:RARE]) for w, o in zip(test.words, orders, strict=True)]
    # padded with a term of the window itself, so that presence is one look-up for all windows
    all_words = np.array([np.resize(w, window) for w in test.words], dtype=np.int64).reshape(len(test.words), window)
    all_rare = np.array([np.resize(r, RARE) for r in rarest], dtype=np.int64).reshape(len(rarest), RARE)
    names = ["" if i is None else str(i) for i, _ in items]
    key = index.schema["row_keys"].dataType.elementType
    rest = "text_hash long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, near array<string>"
    schema = StructType([StructField("row_key", key), *StructType.fromDDL(rest).fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "row_keys"}
                shard = Shard.of(row)
                here = shard.find(test.hashes)
                n = len(shard.sizes)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                found: list[set[str]] = [set() for _ in range(n)]
                around: list[set[str]] = [set() for _ in range(n)]
                for at in np.flatnonzero((here[all_words] >= 0).all(axis=1)).tolist():
                    owner, words = int(test.item[at]), test.words[at]
                    places = exact(shard, words, here, orders[at])
                    for d, p in zip(shard.document(places).tolist(), places.tolist(), strict=True):
                        found[d].add(names[owner])
                        first = p - int(shard.starts[d])
                        if spans[d] and spans[d][-1][0] <= first <= spans[d][-1][1]:
                            spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], first + len(words)))
                        else:
                            spans[d].append((first, first + len(words)))
                # neighbouring windows mostly share their rarest words: one test for each set of an item
                tested: set[tuple] = set()
                for at in np.flatnonzero((here[all_rare] >= 0).all(axis=1)).tolist() if slop else ():
                    owner, rare = int(test.item[at]), rarest[at]
                    wanted = (owner, *rare.tolist())
                    if len(rare) == RARE and wanted not in tested:
                        tested.add(wanted)
                        for d in set(shard.document(near(shard, here[rare].tolist(), slop)).tolist()):
                            around[d].add(names[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_keys").slice(i, 1).flatten(),
                        pa.array(row["text_hashes"], pa.int64()),
                        pa.array(shard.sizes, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span),
                        pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                        pa.array([sorted(f) for f in around], pa.list_(pa.string())),
                    ],
                    schema.names,
                )

    return index.mapInArrow(run, schema)


def _summed(found: DataFrame) -> DataFrame:
    """`spans` replaced by `n_hit`, the words inside any of them. Without Python, so that a task has one worker for
    the search and none for this."""
    total = """aggregate(array_sort(spans), struct(0L AS total, 0L AS reach), (a, s) -> struct(
        a.total + greatest(s.end - greatest(s.start, a.reach), 0L) AS total, greatest(a.reach, s.end) AS reach), a -> a.total)"""
    return found.withColumn("n_hit", F.coalesce(F.expr(total), F.lit(0).cast("long"))).drop("spans")


def search(
    index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", window: int = 13, slop: int = 26, block: int = 5_000
) -> DataFrame:
    """(row_key, text_hash, n_words, n_hit, items, near) of every indexed document.

    `items` are the ids, as sorted strings, of test items with a window that occurs; `n_hit` counts the document's
    words inside such windows; `near` are items with a window whose four rarest words occur within `slop` words of its
    rarest one. Test items go to the tasks in blocks of `block` items, so what is sent along is bounded.
    """
    parts, held = [], []
    for row in items.select(F.col(item).alias("i"), F.col(text).alias("t")).filter(F.col(text).isNotNull()).toLocalIterator():
        held.append((row.i, row.t))
        if len(held) == block:
            parts.append(_block(index, held, window, slop))
            held = []
    if held or not parts:
        parts.append(_block(index, held, window, slop))
    if len(parts) == 1:
        return _summed(parts[0])
    # copies of a text have equal hits, so rows of one key and text may meet; their number is kept
    joined = parts[0].withColumn("block", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        joined = joined.unionByName(p.withColumn("block", F.lit(i)))
    whole = joined.groupBy("row_key", "text_hash", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        F.count_if(F.col("block") == 0).cast("int").alias("copies"),
    )
    return _summed(whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies"))


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, percent: int = 5, **options
) -> DataFrame:
    """(key, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_near), one row per input row.

    A text is contaminated if at least one of its words is hit and the hit words are at least `percent` percent. NULL
    and empty texts have no words; test items without words match nothing; repeated rows stay apart.
    """
    index = staged(build(docs, key, text, gap=max(window, 64)), "positions")
    found = search(index, items, window=window, **options)
    return found.select(
        F.col("row_key").alias(key),
        "text_hash",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text is not contaminated, all columns unchanged."""
    bad = contamination(docs, items, key, text, **options).filter("contaminated")
    bad = bad.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["_key"]) & (F.xxhash64(docs[text]) == bad["_hash"]), "left_anti")
