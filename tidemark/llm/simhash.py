"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

Fingerprints link at `distance` or fewer differing bits. The bits are grouped into partitions of correlated bits, and
every partition gets its own threshold: if the thresholds t_i fulfil sum(t_i + 1) = distance + 1, two linked
fingerprints are within t_i in at least one partition. Dynamic programming picks the thresholds with the lowest
estimated number of signatures and candidates. Signatures are the partition's bits with t_i of them masked out, so
equal signatures hold all fingerprints within t_i of each other; every candidate pair is verified.

Only distinct fingerprints are compared. A bucket emits the edges of a spanning forest and never all of its pairs;
buckets beyond `block` members are cut into blocks that meet pairwise in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import staged
from .common import sliced, texts, words

BITS, SEED = 64, 42
#: Fingerprints on which candidate counts are estimated: those with the smallest hashes.
ESTIMATED_ON = 4_096
#: Runs up to this length are compared by shifting; longer ones grow a forest.
SHORT_RUN = 16


def fingerprint(some: list[bytes], shingle: int) -> int:
    """Bit i is set if it is set in over half the hashes of the shingles, repeats included; 0 without words."""
    if not some:
        return 0
    joined = b" ".join(some)
    ends = np.cumsum([len(w) + 1 for w in some]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(some))
    n = len(some) - width + 1
    sums = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, n, 1 << 15):
        last = min(n, first + (1 << 15))
        spans = zip(starts[first:last].tolist(), ends[first + width - 1 : last + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): a signed 64-bit fingerprint per row. NULL texts have no words."""
    rows = docs.select(F.col(key), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4_000_000):
            fps = np.array([fingerprint(words(t), shingle) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fps, pa.int64())], [key, "fp"])

    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("fp", LongType())]))


# ---------------------------------------------------------------- partitions and thresholds


def _moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both of two bits set: 64 x 64 sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            sums += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(range(BITS * BITS + 1), pa.int32()), "n": pa.array([*sums.ravel().astype(np.int64), n], pa.int64())}
        )

    found = classes.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    values = np.zeros(BITS * BITS + 1)
    for r in found:
        values[r["at"]] = r["n"]
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of nearly equal width; each takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0.0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 and the lowest sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        ahead: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for steps in range(min(len(cost) - 1, distance + 1 - used) + 1):
                at = (total + cost[steps], [*chosen, steps - 1])
                if used + steps not in ahead or at < ahead[used + steps]:
                    ahead[used + steps] = at
        best = ahead
    return best[distance + 1]


@dataclass(frozen=True)
class Plan:
    """Partitions as bit masks, their thresholds, and the expected cost."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    cost: float

    def signatures(self) -> list[tuple[int, int]]:
        """(partition, kept bits) of every signature of a fingerprint."""
        out = []
        for i, (mask, t) in enumerate(zip(self.masks, self.thresholds, strict=True)):
            bits = [b for b in range(BITS) if mask >> b & 1]
            if t >= 0:
                out += [(i, mask & ~sum(1 << b for b in gone)) for gone in combinations(bits, t)]
        return out


def plan(classes: DataFrame, distance: int) -> Plan:
    """The cheapest grouping and thresholds; correlations from all fingerprints, candidate counts from a sample."""
    n, both = _moments(classes)
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(ESTIMATED_ON).collect()
    fps = np.array([r.fp for r in sample], dtype=np.int64).view(np.uint64)
    scale = (n / max(len(fps), 1)) ** 2
    best: Plan | None = None
    for parts in range(2, distance + 2):
        groups = correlated_groups(n, both, parts)
        masks = [sum(1 << b for b in g) for g in groups]
        costs = []
        for group, mask in zip(groups, masks, strict=True):
            near = np.zeros(BITS + 1)
            own = fps & np.uint64(mask)
            for i in range(0, len(own), 256):
                near += np.bincount(np.bitwise_count(own[i : i + 256, None] ^ own[None, :]).ravel(), minlength=BITS + 1)
            near[0] = max(near[0] - len(own), 0)
            # signatures are shuffled and sorted, candidates only compared: a signature weighs as much as 20 of them
            costs.append(
                [0.0]
                + [
                    20.0 * n * comb(len(group), t) + (near[: t + 1].sum() + 1) * scale * comb(len(group), t) / 2 ** min(t, 1)
                    if comb(len(group), t) <= 600
                    else float("inf")
                    for t in range(distance + 1)
                ]
            )
        cost, thresholds = allocate(costs, distance)
        if best is None or cost < best.cost:
            best = Plan(tuple(masks), tuple(thresholds), cost)
    return best


# ---------------------------------------------------------------- probing


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect exactly the fingerprints that links of `distance` or fewer bits connect."""
    edges, rest = [], fps
    while len(rest) > 1:
        frontier, rest = [rest[:1]], rest[1:]
        while frontier and len(rest):
            for seed in frontier.pop():
                if not len(rest):
                    break
                linked = np.bitwise_count(rest ^ seed) <= distance
                if linked.any():
                    found = rest[linked]
                    edges.append((np.full(len(found), seed), found))
                    frontier.append(found)
                    rest = rest[~linked]
    return edges


def _linked(fps: np.ndarray, runs: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges inside each run of a sorted batch; `runs` has the start of every run and the end of the last."""
    sizes = np.diff(runs)
    short = np.repeat(np.where(sizes <= SHORT_RUN, np.arange(len(sizes)), -1), sizes)
    for shift in range(1, min(int(sizes.max(initial=1)), SHORT_RUN)):
        same = (short[shift:] == short[:-shift]) & (short[shift:] >= 0)
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
        if len(at):
            yield fps[at], fps[at + shift]
    for i in np.flatnonzero(sizes > SHORT_RUN):
        yield from forest(np.unique(fps[runs[i] : runs[i + 1]]), distance)


def _bucket_edges(members: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b as signed numbers: edges found in the buckets (kept, value, left, right)."""
    names = ["kept", "value", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(keys: list[np.ndarray], fps: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _linked(fps.view(np.uint64), ends, distance):
                a, b = a.view(np.int64), b.view(np.int64)
                pair = [pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())]
                yield pa.RecordBatch.from_arrays(pair, ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "fp"]]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            new = np.zeros(len(columns[0]), dtype=bool)
            new[:1] = True
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield from edges(columns[:4], columns[4][: starts[-1]], starts)
                columns = [c[starts[-1] :] for c in columns]
            held = columns
        if held is not None and len(held[4]) > 1:
            yield from edges(held[:4], held[4], np.array([0, len(held[4])]))

    return members.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def links(classes: DataFrame, distance: int, block: int = 4_096) -> DataFrame:
    """(a, b): edges that connect what `distance` or fewer differing bits link, among the distinct fingerprints `fp`."""
    chosen = plan(classes, distance)
    signatures = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(_signed(kept)).alias("kept")) for i, kept in chosen.signatures()))
    exploded = classes.select("fp", F.explode(signatures).alias("s"))
    members = exploded.select("fp", F.col("s.kept").alias("kept"), F.col("fp").bitwiseAND(F.col("s.kept")).alias("value"))

    # a bucket of more than `block` members holds a value of its whole partition with over block / 2^t members
    whole = F.array(*(
        F.struct(F.lit(i).alias("part"), F.lit(_signed(m)).alias("mask"), F.lit(block >> t).alias("most"))
        for i, (m, t) in enumerate(zip(chosen.masks, chosen.thresholds, strict=True)) if t >= 0
    ))
    values = classes.select("fp", F.explode(whole).alias("s"))
    values = values.groupBy("s.part", "s.most", F.col("fp").bitwiseAND(F.col("s.mask")).alias("v"))
    heavy = values.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.col("most"))
    hot = heavy.select("part", "v", F.explode(signatures).alias("s")).filter(F.col("s.part") == F.col("part"))
    hot = staged(hot.select(F.col("s.kept").alias("kept"), F.col("v").bitwiseAND(F.col("s.kept")).alias("value")).distinct(), "simhash-hot")

    key = ["kept", "value"]
    cold = members.join(hot, key, "left_anti").select(*key, F.lit(0).alias("left"), F.lit(0).alias("right"), "fp")
    crowded = members.join(hot, key)
    blocks = crowded.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    salted = crowded.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "fp")
    return _bucket_edges(cold.unionByName(met), distance).distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of its component for every node that an edge touches.

    Alternating large and small stars; each round is written to the shared folder, so lineage stays short and a lost
    executor costs a part of one round. The driver sees two counts per round.
    """

    def star(rows: DataFrame, large: bool) -> DataFrame:
        around = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            around = around.filter("b < a")
        least = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = around.join(least, "a")
        moved = moved.filter("b > a") if large else moved
        out = moved.select(F.col("low").alias("a"), "b")
        if not large:
            out = out.unionByName(least.select(F.col("low").alias("a"), F.col("a").alias("b")))
        return out.filter("a < b").distinct()

    def settled(rows: DataFrame) -> bool:
        """Whether the edges are stars: every larger end has one smaller end, which is nobody's larger end."""
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("b").alias("b")).first()
        return seen.n == seen.b and rows.join(rows.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()

    rows = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "star")
    for _ in range(most_rounds):
        if settled(rows):
            break
        rows = staged(star(star(rows, True), False), "star")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return rows.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _labelled(found: DataFrame, distance: int, block: int) -> DataFrame:
    """(fp, first, root): the smallest key and the component of every distinct fingerprint of `found` (row_key, fp)."""
    classes = staged(found.groupBy("fp").agg(F.min("row_key").alias("first")), "simhash-classes")
    roots = components(links(classes, distance, block))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text", block: int = 4_096
) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    `fingerprint` has 16 lower-case hexadecimal digits, `component_id` is the smallest key that links reach, the row
    itself included. Texts without words have fingerprint zero and are linked like any other. Rows with equal texts
    share one fingerprint and cost one comparison; rows with equal keys stay apart; a component whose keys are all
    NULL has a NULL id. Other columns are ignored.
    """
    found = staged(fingerprints(docs, shingle, key, text).select(F.col(key).alias("row_key"), "fp"), "simhash")
    labelled = _labelled(found, distance, block)
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        F.col("row_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text", block: int = 4_096
) -> DataFrame:
    """One row of every component of near-duplicates: the one with the smallest key (NULL last), all columns unchanged.

    Rows are told apart by key and text, so rows of different components that share a key, or have none, all stay. Of
    several rows of a component with that key, the smallest by all columns stays.
    """
    rows = docs.select(F.struct(F.col(key).alias("row_key"), F.xxhash64(text).alias("text_hash")).alias("at"), F.col(text).alias("text"))
    found = staged(fingerprints(rows, shingle, "at").select("at.*", "fp"), "simhash")
    placed = found.join(_labelled(found, distance, block).select("fp", "root"), "fp").withColumn("no_key", F.col("row_key").isNull())
    least = placed.groupBy("root").agg(F.min(F.struct("no_key", "row_key")).alias("least"))
    firsts = placed.join(least, "root").filter(F.struct("no_key", "row_key").eqNullSafe(F.col("least")))
    firsts = firsts.select("root", F.col("row_key").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    firsts = firsts.withColumnRenamed("root", "_root")
    kept = docs.join(firsts, docs[key].eqNullSafe(firsts["_key"]) & (F.xxhash64(docs[text]) == firsts["_hash"]))
    least = kept.groupBy("_root").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return least.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
