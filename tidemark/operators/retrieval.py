"""Exact nearest vectors by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES_PER_PASS = 1024
#: Rows scored at a time: with all queries of a pass a matrix of 16 MB.
ROWS_PER_STEP = 2_048


def top_k_similar(docs: DataFrame, key: str, vector: str, queries: DataFrame | list[tuple[int, list[float]]], k: int = 5) -> DataFrame:
    """The k most similar rows per query: query_id, key, score, rank. NULL vectors are skipped.

    Queries are (query_id, vector) rows of a DataFrame, or a list of such pairs. They go to the tasks in blocks of
    QUERIES_PER_PASS; each task scores its rows against the block and passes on its own best k per query, so the
    shuffle holds k rows per query and task. Equal scores rank by key. A vector of length zero has no direction: its
    score is NULL and it ranks behind all others.
    """
    rows = docs.where(F.col(vector).isNotNull()).select(key, vector)
    kind = dict(docs.dtypes)[key]
    passes = [_local_best(rows, key, vector, kind, block, k) for block in _blocks(queries)]
    if not passes:
        return docs.sparkSession.createDataFrame([], f"query_id long, {key} {kind}, score double, rank int")
    found = reduce(DataFrame.unionByName, passes)
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(key))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame | list, size: int = QUERIES_PER_PASS) -> Iterator[list[tuple[int, list[float]]]]:
    """Queries a block at a time; those of a DataFrame pass through the driver partition by partition."""
    source = iter(queries) if isinstance(queries, list) else ((r[0], list(r[1])) for r in queries.toLocalIterator() if r[1] is not None)
    while block := list(islice(source, size)):
        yield block


def best_rows(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by key; a selection, and a sort of what is left."""
    if len(scores) > k:
        least = scores[np.argpartition(-scores, k - 1)[:k]].min()
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((keys[some], -scores[some]))[:k]]


def _local_best(rows: DataFrame, key: str, vector: str, kind: str, queries: list, k: int) -> DataFrame:
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix /= np.where(lengths == 0, 1.0, lengths)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=object))] * len(ids)
        for batch in batches:
            for first in range(0, len(batch), ROWS_PER_STEP):
                part = batch.iloc[first : first + ROWS_PER_STEP]
                vectors, keys = np.stack(part[vector].to_numpy()).astype(np.float64), part[key].to_numpy()
                norms = np.linalg.norm(vectors, axis=1)
                scores = matrix @ (vectors / np.where(norms == 0, 1.0, norms)[:, None]).T
                scores[:, norms == 0] = -np.inf
                for q, row in enumerate(scores):
                    near = best_rows(row, keys, k)
                    both = np.concatenate([kept[q][0], row[near]]), np.concatenate([kept[q][1], keys[near].astype(object)])
                    again = best_rows(*both, k)
                    kept[q] = both[0][again], both[1][again]
        for q, (scores, keys) in zip(ids, kept, strict=True):
            if len(scores):
                known = pd.Series(scores).where(np.isfinite(scores), None).astype("Float64")
                yield pd.DataFrame({"query_id": np.full(len(scores), q), key: keys, "score": known})

    return rows.mapInPandas(best, f"query_id long, {key} {kind}, score double")


def group_centroids(docs: DataFrame, group: str, vector: str) -> DataFrame:
    """(query_id, vector): the mean vector of every group."""
    cells = docs.select(group, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return vectors.select(F.col(group).cast("long").alias("query_id"), F.transform("cells", lambda c: c["x"]).alias("vector"))


def retrieval_prefix(found: DataFrame, docs: DataFrame, key: str, content: str) -> DataFrame:
    """One text per query that lists the retrieved contents as [1], [2], ... in rank order."""
    lines = found.join(docs.select(key, content), key).select(
        "query_id", F.struct("rank", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col(content)).alias("t")).alias("line")
    )
    listed = F.transform(F.sort_array(F.collect_list("line")), lambda x: x["t"])
    lead = "Use the following context to inform your answer. If not relevant, say so.\n\n"
    return lines.groupBy("query_id").agg(F.concat(F.lit(lead), F.array_join(listed, "\n\n")).alias("prefix"))
