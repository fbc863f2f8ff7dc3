"""Nearest vectors by inverted lists: a coarse quantiser, exact scores inside the lists, and a bound that makes it exact.

Unit vectors are dealt to the nearest of a bounded number of centres; a list is a folder of its own, so a search reads the
folders of the lists it probes and no others. Probing a few lists is approximate. The exact way goes on from there: no
vector of a list can be nearer than the distance to its centre less the list's radius, so only lists whose bound
beats the k-th best found so far are read as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged
from .retrieval import _blocks, best_rows

LIST = "list"
#: Vectors on which centres are fitted: those whose keys have the smallest hashes.
FITTED_ON = 100_000
MOST_LISTS = 4_096
#: Vectors without a direction have no score; they are a list of their own, read when too few others are there.
NO_DIRECTION = -1
#: Queries of one pass over the lists, and scores computed at a time: a matrix of 16 MB.
QUERIES_PER_PASS, CELLS = 4_096, 2_097_152
#: Rounding of single distances.
SLACK = 1e-6
#: Rounding of single scores in a product of matrices.
ROUNDING = 1e-9


class Found(NamedTuple):
    """The best rows (query_id, key, score, rank), and per query the lists and rows that were read for it."""

    rows: DataFrame
    scanned: DataFrame


@dataclass(frozen=True)
class VectorIndex:
    """Inverted lists below `path`; centres and radii, at most MOST_LISTS of them, are held by the driver."""

    spark: SparkSession
    path: str
    key: str
    vector: str
    centres: np.ndarray
    numbers: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(norms == 0, 1.0, norms)[:, None], norms == 0


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def build(docs: DataFrame, key: str, vector: str, path: str, lists: int | None = None, fitted_on: int = FITTED_ON, seed: int = 1) -> VectorIndex:
    """Index every row whose vector is not NULL; centres are fitted on at most `fitted_on` of them.

    Without `lists` there are as many as the square root of the rows, at most MOST_LISTS.
    """
    rows = docs.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    count = rows.count()
    wanted = max(1, min(lists or int(np.sqrt(count)), MOST_LISTS))
    length = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    sample = rows.where(length > 0).orderBy(F.xxhash64(key), key).limit(fitted_on).select(array_to_vector(vector).alias("features"))
    centres, first = np.zeros((0, 1)), sample.limit(2).collect()
    if first and (wanted < 2 or len(first) < 2):
        centres, _ = _unit(np.array([first[0]["features"].toArray()]))
    elif first:
        model = KMeans(k=wanted, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
        centres, _ = _unit(np.array(model.clusterCenters()))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors, none = _unit(np.stack(batch[vector].to_numpy()))
            apart = _distance(vectors, centres) if len(centres) else np.zeros((len(batch), 1))
            nearest = apart.argmin(axis=1)
            yield batch.assign(**{LIST: np.where(none, NO_DIRECTION, nearest), "distance": np.where(none, 0.0, apart[np.arange(len(batch)), nearest])})

    kinds = dict(rows.dtypes)
    dealt = rows.mapInPandas(assign, f"{key} {kinds[key]}, {vector} array<double>, {LIST} int, distance double")
    dealt.repartition(LIST, F.pmod(F.xxhash64(key), F.lit(1 + count // (MOST_LISTS * 1_000)))).write.partitionBy(LIST).parquet(path)
    spark = docs.sparkSession
    known = _read(spark, path, key, vector, kinds[key]).groupBy(LIST).agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect() if count else []
    known = sorted(known, key=lambda r: r[LIST])
    directed = [r for r in known if r[LIST] != NO_DIRECTION]
    numbers = np.array([r[LIST] for r in directed], np.int64)
    lost = [r["n"] for r in known if r[LIST] == NO_DIRECTION]
    return VectorIndex(
        spark, path, key, vector, centres[numbers] if len(numbers) else centres[:0], numbers, np.array([r["radius"] for r in directed]),
        np.array([*(r["n"] for r in directed), *(lost or [0])], np.int64),
    )


def _read(spark: SparkSession, path: str, key: str, vector: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{key} {kind}, {vector} array<double>, distance double, {LIST} int").parquet(path)


def search(index: VectorIndex, queries: DataFrame | list, k: int = 5, probes: int = 8, exact: bool = False) -> Found:
    """The k rows of highest cosine similarity per query, from its `probes` nearest lists or, with `exact`, from all rows.

    Queries are (query_id, vector) rows; they go to the tasks in blocks, as in `retrieval.top_k_similar`, whose rows the
    exact way gives. Equal scores rank by key; vectors without a direction come last, without a score.
    """
    spark, kind = index.spark, index.spark.read.parquet(index.path).schema[index.key].dataType.simpleString() if index.sizes.sum() else "long"
    parts, read = [], []
    for block in _blocks(queries, QUERIES_PER_PASS):
        ids = np.array([q for q, _ in block], np.int64)
        matrix, none = _unit(np.array([v for _, v in block], np.float64))
        apart = _distance(matrix, index.centres) if len(index.centres) else np.zeros((len(ids), 0))
        order = np.argsort(apart, axis=1, kind="stable")
        probed = np.zeros(apart.shape, dtype=bool)
        np.put_along_axis(probed, order[:, :probes], True, axis=1)
        found = _scan(index, kind, ids, matrix, probed, np.zeros(len(ids), dtype=bool), k)
        seen, lost = probed, np.zeros(len(ids), dtype=bool)
        if exact:
            # the k-th best score so far bounds the distance; fewer than k found bound nothing
            found = staged(found, "probed")
            kth = {r["query_id"]: r["score"] for r in _best(found, index.key, k).where(F.col("rank") == k).collect()}
            limit = np.array([np.sqrt(max(2.0 - 2.0 * kth[q], 0.0)) if kth.get(q) is not None else np.inf for q in ids.tolist()])
            more = ~probed & (apart - index.radii[None, :] <= limit[:, None] + SLACK)
            more[none] = ~probed[none]
            total = (more | probed) @ index.sizes[:-1] if len(index.centres) else np.zeros(len(ids))
            lost = total < k
            if more.any() or (lost.any() and index.sizes[-1]):
                floor = np.array([kth[q] - SLACK if kth.get(q) is not None else -np.inf for q in ids.tolist()])
                found = found.unionByName(_scan(index, kind, ids, matrix, more, lost, k, floor))
            seen = probed | more
        parts.append(found)
        rows = seen.astype(np.int64) @ index.sizes[:-1] + lost * index.sizes[-1]
        read += list(zip(ids.tolist(), seen.sum(axis=1).tolist(), rows.tolist(), strict=True))
    schema = f"query_id long, {index.key} {kind}, score double"
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return Found(_best(rows, index.key, k), spark.createDataFrame(read, "query_id long, lists long, rows long"))


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(key))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def _scan(
    index: VectorIndex, kind: str, ids: np.ndarray, matrix: np.ndarray, probed: np.ndarray, lost: np.ndarray, k: int, floor: np.ndarray | None = None
) -> DataFrame:
    """Each task's best k rows per query from the lists that the query probes; `lost` queries also read rows without direction.

    `floor` is a score per query that k rows are known to reach: rows below it are not kept. Rows are compared with that and
    with the k-th best so far for all queries at once; only queries for which a row gets there are looked at one by one.
    """
    key, vector = index.key, index.vector
    # one bit per query and list goes to the tasks
    askers = {int(n): np.packbits(probed[:, i]) for i, n in enumerate(index.numbers) if probed[:, i].any()}
    if lost.any():
        askers[NO_DIRECTION] = np.packbits(lost)
    start = np.full(len(ids), -np.inf) if floor is None else floor

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least = start.copy()
        for batch in batches:
            for number, rows in batch.groupby(LIST, sort=False):
                asking = np.flatnonzero(np.unpackbits(askers[int(number)], count=len(ids)))
                step = max(1, CELLS // len(asking))
                for first in range(0, len(rows), step):
                    part = rows.iloc[first : first + step]
                    vectors, none = _unit(np.stack(part[vector].to_numpy()))
                    scores, keys = matrix[asking] @ vectors.T, part[key].to_numpy().astype(object)
                    scores[:, none] = -np.inf
                    near = scores >= least[asking][:, None] - ROUNDING
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        q, some = int(asking[i]), near[i]
                        old = kept.get(q, (np.empty(0), np.empty(0, dtype=object)))
                        # summed row by row: equal vectors have equal scores wherever they stand, and rank by key
                        own = np.where(none[some], -np.inf, (vectors[some] * matrix[q]).sum(axis=1))
                        both = np.concatenate([old[0], own]), np.concatenate([old[1], keys[some]])
                        again = best_rows(*both, k)
                        kept[q] = both[0][again], both[1][again]
                        if len(again) == k:
                            least[q] = max(least[q], kept[q][0][-1])
        for q, (scores, keys) in kept.items():
            known = pd.Series(scores).where(np.isfinite(scores), None).astype("Float64")
            yield pd.DataFrame({"query_id": np.full(len(scores), ids[q]), key: keys, "score": known})

    schema = f"query_id long, {key} {kind}, score double"
    if not askers:
        return index.spark.createDataFrame([], schema)
    rows = _read(index.spark, index.path, key, vector, kind).where(F.col(LIST).isin(sorted(askers)))
    return rows.select(key, vector, LIST).mapInPandas(best, schema)


def tuned_probes(index: VectorIndex, queries: list[tuple[int, list[float]]], k: int = 5, least: float = 0.95) -> int:
    """The fewest probes, of 1, 2, 4 and so on, with which the queries find a share of `least` of their exact neighbours.

    Give it a bounded sample of queries; every try is one search.
    """
    exact = search(index, queries, k, exact=True).rows.persist()
    probes = 1
    while probes < len(index.numbers):
        share = recall(search(index, queries, k, probes).rows, exact, index.key).first()["recall"]
        if share is None or share >= least:
            break
        probes *= 2
    exact.unpersist()
    return max(1, min(probes, len(index.numbers)))


def recall(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: how many expected (query, key) pairs there are, and the share of them that was found."""
    hits = found.select("query_id", key).withColumn("hit", F.lit(1))
    joined = expected.select("query_id", key).join(hits, ["query_id", key], "left")
    return joined.agg(F.count(F.lit(1)).alias("pairs"), F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))
