"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is its set of distinct word shingles; documents with equal sets are one class. A class has one signature of
TREES * LEVELS minima, and every tree reads it in an order of its own: its label is the sequence of LEVELS of these
values, and classes sorted by label have the longest common prefixes with their neighbours. Classes whose labels share a
prefix are a region of the tree. Regions begin at depth SURE, where a pair of similarity 0.8 shares a region of
at least one of the 32 trees with probability 1 - 5 * 10^-8, and a region goes one level deeper as long as it holds more than
`region` classes. Within a region, sketches of one bit per minimum choose the candidates.

Candidates only say which documents are looked at together. Their connected groups get the texts back, and links are
confirmed on the full sets, every text shuffled once. A region or group that is too large for one task is cut into
blocks that all hold the same few leaders; members that the leaders do not connect then meet every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged
from .common import sliced, texts, words
from .simhash import components

TREES, LEVELS, SURE = 32, 8, 4
MINIMA = TREES * LEVELS
#: Differing bits of two sketches: 25.6 of 256 expected at similarity 0.8, standard deviation 4.8.
MOST_BITS = 54
#: Classes that one task compares by sketch, and weight (shingles, 1,000 at least per text) that one compares by sets.
REGION, GROUP = 4_096, 4_000_000
#: Expected number of leaders of a region or group that one task cannot hold.
LEADERS = 64
SKETCH = [f"s{i}" for i in range(MINIMA // 64)]
_RNG = np.random.default_rng(11)
_FACTORS = (_RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ODD = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 1 << 63, 4)]


class Words(dict):
    """64-bit hashes of words, kept for the words of recent texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(some: list[bytes], width: int, known: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words the whole sequence is the only one."""
    if not some:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, some), np.uint64, len(some))
    used = min(width, len(some))
    n = len(some) - used + 1
    out = np.full(n, used, np.uint64) * _ODD[2]
    for i in range(used):
        out = _mixed(out * _ODD[3] + hashes[i : i + n])
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """MINIMA 32-bit minima of a set that is not empty."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2_048):
        np.minimum(low, (short[i : i + 2_048, None] * _FACTORS).min(axis=0), out=low)
    return low


def _signatures(batch_sets: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """Labels of all trees as 16-bit levels, and sketches, one byte string each per set; empty for empty sets."""
    labels, sketches = [], []
    for found in batch_sets:
        if not len(found):
            labels.append(b"")
            sketches.append(b"")
            continue
        spread = minima(found) * np.uint32(0x9E3779B1)
        labels.append((spread >> np.uint32(16)).astype("<u2").tobytes())
        sketches.append(np.packbits((spread >> np.uint32(15)) & np.uint32(1)).tobytes())
    return labels, sketches


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """`rows` (no_key, row_key, text_hash, text) with the set of every text instead: size, digest, label, sketch."""
    kept = [rows.schema[c] for c in ("no_key", "row_key", "text_hash")]
    schema = StructType([*kept, *StructType.fromDDL("n long, digest binary, label binary, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in sliced(batches, "text", 8_000_000):
            found = [shingles(words(t), width, known) for t in texts(batch)]
            labels, sketches = _signatures(found)
            digests = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
            own = [pa.array([len(f) for f in found], pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, labels, sketches))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *own], schema.names)

    return rows.mapInArrow(run, schema)


def _trees(classes: DataFrame) -> DataFrame:
    """(tree, high, low, id, n, sketch words): one row per class and tree; `high` has the first SURE levels of the label."""
    schema = "tree int, high long, low long, id long, n long, " + ", ".join(f"{s} long" for s in SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                labels = np.frombuffer(b"".join(part.column("label").to_pylist()), ">i8").reshape(-1, 2).astype(np.int64)
                sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.int64).reshape(-1, len(SKETCH))
                each = [np.repeat(part.column(c).to_numpy(), TREES) for c in ("id", "n")]
                tree = np.tile(np.arange(TREES, dtype=np.int32), part.num_rows)
                columns = [tree, labels[:, 0], labels[:, 1], *each, *np.repeat(sketches, TREES, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "high", "low", "id", "n", *SKETCH])

    return classes.select("id", "n", "label", "sketch").mapInArrow(run, schema)


# ---------------------------------------------------------------- groups that fit into a task, and others


def _linked_rows(rows: DataFrame, keys: list[str], most: int, size: Column, connect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges that connect what is linked within each group of `rows` (keys, id, ...).

    `connect` gets rows with `left` and `right` and links those that agree in keys, left and right. Groups of a total
    size up to `most` are dealt to it whole. Larger ones come in blocks, each with the leaders; whoever is then not in
    the component of most of the group meets every block once more.
    """
    zero = F.lit(0).cast("long")
    total = rows.groupBy(*keys).agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("members")).filter(F.col("total") > most)
    large = staged(total.select(*keys, F.least(F.ceil(F.col("total") / most).cast("long"), "members").alias("blocks"), "members"), "forest-large")
    if large.isEmpty():
        return connect(rows.select("*", zero.alias("left"), zero.alias("right")))
    small = rows.join(large, keys, "left_anti").select("*", zero.alias("left"), zero.alias("right"))
    crowd = staged(rows.join(large, keys).withColumn("own", F.pmod(F.xxhash64("id"), "blocks")), "forest-crowd")
    leads = F.pmod(F.xxhash64("id", F.lit("lead")), F.greatest(F.lit(1), F.floor(F.col("members") / LEADERS))) == 0
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    blocks = crowd.withColumn("left", F.explode(F.when(leads, everywhere).otherwise(F.array("own")))).withColumn("right", F.lit(-1).cast("long"))
    edges = staged(connect(small.unionByName(blocks.select(*small.columns))), "forest-edges")

    roots = components(edges).toDF("_node", "_root")
    placed = crowd.join(roots, F.col("id") == F.col("_node"), "left").withColumn("part", F.coalesce("_root", "id")).drop("_node", "_root")
    main = placed.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("m")).groupBy(*keys).agg(F.max_by("part", F.struct("m", "part")).alias("main"))
    lone = staged(placed.join(main, keys).filter("part != main").drop("part", "main"), "forest-lone")
    if lone.isEmpty():
        return edges
    parts = lone.groupBy(*keys).agg(F.least(F.ceil(F.sum(size) / most).cast("long"), F.count(F.lit(1))).alias("parts"))
    some = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    apart = lone.join(parts, keys).withColumn("left", F.pmod(F.xxhash64("id"), "parts")).withColumn("right", F.explode(everywhere))
    whole = crowd.join(parts, keys).withColumn("left", F.explode(some)).withColumn("right", F.col("own"))
    return edges.unionByName(connect(apart.select(*small.columns).unionByName(whole.select(*small.columns))))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that begin and end with a group; with the starts of the groups and the end."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        if last:
            yield table, np.append(starts, table.num_rows)
        elif len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            held = table.slice(starts[-1]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            one = all(batch.column(k)[0] == batch.column(k)[-1] == held[0].column(k)[0] for k in keys)
            if not one:
                yield from cut(False)
    if held:
        yield from cut(True)


def _edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        differ = a != b
        a, b = a[differ], b[differ]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(seed, members linked to it): edges that connect exactly what links connect. `linked(i, rest)` marks the linked of `rest`."""
    out, rest = [], np.arange(n)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            hit = linked(seed, rest)
            if hit.any():
                out.append((seed, rest[hit]))
                queue.extend(rest[hit])
                rest = rest[~hit]
    return out


def _by_sketch(percent: int):
    """Sketch links of the regions."""
    keys = ["tree", "high", "deep", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(batches, keys):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            bits = np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1).view(np.uint64)

            def near(a: np.ndarray, b: np.ndarray, n: np.ndarray = n, bits: np.ndarray = bits) -> np.ndarray:
                sized = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                return sized & (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= MOST_BITS)

            pairs, sizes = [], np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[near(two, two + 1)]
            pairs.append((ids[two], ids[two + 1]))
            for first, last in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist(), strict=True):
                found = spanning(last - first, lambda i, rest, at=first, near=near: near(np.full(len(rest), at + i), at + rest))
                pairs += [(np.full(len(hit), ids[first + i]), ids[first + hit]) for i, hit in found]
            yield from _edge_batch(pairs)

    def connect(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, "low").select(*keys, "id", "n", *SKETCH).mapInArrow(run, "a long, b long").distinct()

    return connect


def _candidates(classes: DataFrame, percent: int, region: int) -> DataFrame:
    """(a, b): edges between classes that share a region of a tree and have near sketches."""
    trees = _trees(classes)
    prefix = ["tree", "high"]
    busy = staged(trees.groupBy(*prefix).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > region).select(*prefix), "forest-busy")
    zero = F.lit(0).cast("long")
    if busy.isEmpty():
        return _by_sketch(percent)(trees.select("*", *(zero.alias(c) for c in ("deep", "left", "right"))))
    rows, left, at = trees.join(busy, prefix, "left_anti").withColumn("deep", zero), staged(trees.join(busy, prefix), "forest-deeper"), [*prefix, "deep"]
    for level in range(1, LEVELS - SURE + 1):
        # the values of one more level join the prefix, hashed with their number so that prefixes of two depths differ
        value = F.shiftrightunsigned("low", 16 * (LEVELS - SURE - level)) if level < LEVELS - SURE else F.col("low")
        left = left.withColumn("deep", F.xxhash64(F.lit(level), value))
        counts = left.groupBy(*at).agg(F.count(F.lit(1)).alias("m"))
        done = staged(counts.filter((F.col("m") <= region) | F.lit(level == LEVELS - SURE)).select(*at), "forest-done")
        rows = rows.unionByName(left.join(done, at, "left_semi").select(*rows.columns))
        left = staged(left.join(done, at, "left_anti"), "forest-deeper")
    return _linked_rows(rows, at, region, F.lit(1), _by_sketch(percent))


# ---------------------------------------------------------------- confirmation on full sets


def _by_sets(width: int, percent: int):
    """Links of texts whose shingle sets fulfil 100 |intersection| >= percent |union|."""
    keys = ["root", "left", "right"]

    def group(ids: np.ndarray, found: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(f) for f in found])
        _, flat = np.unique(np.concatenate(found), return_inverse=True)
        ends = np.cumsum(sizes)
        parts = np.split(flat, ends[:-1])
        mark = np.zeros(int(flat.max()) + 1, dtype=bool)
        held: dict[str, np.ndarray] = {}

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            # the joined sets of `rest` are built anew only when it has shrunk
            if len(held.get("rest", ())) != len(rest):
                held["rest"] = rest
                held["flat"] = np.concatenate([parts[r] for r in rest])
                held["starts"] = np.cumsum(sizes[rest]) - sizes[rest]
            mark[parts[i]] = True
            both = np.add.reduceat(mark[held["flat"]].astype(np.int64), held["starts"])
            mark[parts[i]] = False
            return (100 + percent) * both >= percent * (sizes[i] + sizes[rest])

        return [(np.full(len(hit), ids[i]), ids[hit]) for i, hit in spanning(len(found), linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for table, starts in _runs((b for batch in batches for b in sliced([batch], "text", 4_000_000)), keys):
            ids, column = table.column("id").to_numpy(), table.column("text")
            pairs = []
            for first, last in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                if last - first > 1:
                    found = [shingles(words(t), width, known) for t in column.slice(first, last - first).to_pylist()]
                    pairs += group(ids[first:last], found)
            yield from _edge_batch(pairs)

    def connect(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "id", "text").mapInArrow(run, "a long, b long").distinct()

    return connect


def near_duplicates(
    docs: DataFrame, width: int = 2, percent: int = 80, key: str = "doc_id", text: str = "text", region: int = REGION, group: int = GROUP
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Rows are linked if 100 |intersection| >= percent |union| of their sets of distinct `width`-word shingles;
    `component_id` is the smallest key that links reach, the row itself included, and `kept` says that it is the row's own.
    A text of fewer words has one shingle, its whole sequence; NULL texts and texts without words have none and are
    linked with nothing. Rows with equal sets are compared once. Rows with equal keys stay apart; a component
    whose keys are all NULL has a NULL id and keeps all its rows. Other columns are ignored.
    """
    column = F.col(key)
    rows = docs.select(column.isNull().alias("no_key"), column.alias("row_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    found = staged(_sets(rows, width), "forest-sets")
    place = F.struct("no_key", "row_key", "text_hash")
    classes = found.filter("n > 0").groupBy("digest").agg(
        F.min(place).alias("first"), F.first("n").alias("n"), F.first("label").alias("label"), F.first("sketch").alias("sketch")
    )
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "forest-classes")

    together = components(_candidates(classes, percent, region))
    grouped = together.unionByName(together.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
    members = classes.select("id", "n", "first.row_key", "first.text_hash").join(grouped, "id")
    members = members.withColumnRenamed("row_key", "first_key").withColumnRenamed("text_hash", "first_hash")
    same = rows.row_key.eqNullSafe(members.first_key) & (rows.text_hash == members.first_hash)
    wanted = rows.join(members, same).select("root", "id", "n", "text").dropDuplicates(["id"])
    wanted = staged(wanted, "forest-texts")
    size = F.greatest(F.col("n"), F.lit(1_000))
    roots = components(_linked_rows(wanted, ["root"], group, size, _by_sets(width, percent)))

    placed = classes.select("digest", "id", "first").join(roots, classes["id"] == roots["node"], "left").withColumn("part", F.coalesce("root", "id"))
    least = placed.groupBy("part").agg(F.min(F.struct("first.no_key", "first.row_key"))["row_key"].alias("component_id"))
    named = placed.join(least, "part").select("digest", "component_id")
    out = found.filter("n > 0").join(named, "digest").select("row_key", "n", "component_id")
    out = out.unionByName(found.filter("n = 0").select("row_key", "n", F.col("row_key").alias("component_id")))
    return out.select(
        F.col("row_key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("row_key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def oracle_sql() -> str:
    """The same over `documents` in DuckDB, all pairs that share a shingle compared; NULL ids left out."""
    return """
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM docs),
classes AS (SELECT s, min(r) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS (SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.c, b.c HAVING 180 * count(*) >= 80 * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT c, c AS o FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.o),
firsts AS (SELECT classes.c, min(sets.doc_id) AS first FROM sets JOIN classes USING (s) GROUP BY classes.c),
parts AS (SELECT reach.c, min(first) AS component_id FROM reach JOIN firsts ON firsts.c = reach.o GROUP BY reach.c)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
    doc_id IS NOT DISTINCT FROM CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN parts USING (c)
"""
