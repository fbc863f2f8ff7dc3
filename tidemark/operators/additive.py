"""Additive demand model: a trend with bends, and a weekly season, fitted to all keys at once.

A key's units are regressed on a level, a slope, hinges at evenly spaced bends in the first four fifths of its days, and
sine and cosine pairs of the week. Ridge penalties hold hinges and season back, as priors would. Spark adds up the normal
equations of every key with map-side sums; one small dense system per key is then solved in vectorised batches, so no
history of a key is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forecast import HORIZON, KEYS, data_confidence

PERIOD = 7


def design(bends: int, order: int) -> list[str]:
    """Names of the regressors."""
    return ["level", "slope", *(f"bend{i}" for i in range(bends)), *(f"{f}{i}" for i in range(1, order + 1) for f in ("sin", "cos"))]


def _bend(i: int, bends: int) -> float:
    return 0.8 * (i + 1) / (bends + 1)


def _columns(day: Column, span: Column, weekday: Column, bends: int, order: int) -> list[Column]:
    at = day / span
    angle = [2 * np.pi * i / PERIOD * weekday for i in range(1, order + 1)]
    return [F.lit(1.0), at, *(F.greatest(at - _bend(i, bends), F.lit(0.0)) for i in range(bends)), *(f(a) for a in angle for f in (F.sin, F.cos))]


def _matrix(day: np.ndarray, span: np.ndarray, weekday: np.ndarray, bends: int, order: int) -> np.ndarray:
    """The same regressors in numpy, along a new last axis."""
    at = day / span
    angle = [2 * np.pi * i / PERIOD * weekday for i in range(1, order + 1)]
    return np.stack([np.ones_like(at), at, *(np.maximum(at - _bend(i, bends), 0) for i in range(bends)), *(f(a) for a in angle for f in (np.sin, np.cos))], axis=-1)


def normal_equations(history: DataFrame, keys: list[str] = KEYS, bends: int = 3, order: int = 3) -> DataFrame:
    """(keys, first_day, last_day, days, units, xx, xy): per key the sums of products of its regressors, the upper
    triangle row by row, and of regressors with units. Days count from the key's own first one."""
    ends = history.groupBy(*keys).agg(F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"))
    span = F.greatest(F.datediff("last_day", "first_day"), F.lit(1)).cast("double")
    dated = history.join(ends, keys)
    x = F.array(*_columns(F.datediff("sale_date", "first_day").cast("double"), span, F.weekday("sale_date").cast("double"), bends, order))
    y = F.col("units_sold").cast("double")
    size = len(design(bends, order))
    rows = dated.select(*keys, "first_day", "last_day", "sale_date", y.alias("y"), x.alias("x"))
    xx = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(size) for j in range(i, size)]
    xy = [F.sum(F.col("x")[i] * F.col("y")) for i in range(size)]
    sums = rows.groupBy(*keys).agg(
        F.first("first_day").alias("first_day"), F.first("last_day").alias("last_day"),
        F.count_distinct("sale_date").alias("days"), F.sum("y").alias("units"), F.count(F.lit(1)).alias("rows"),
        *[c.alias(f"xx{n}") for n, c in enumerate(xx)], *[c.alias(f"xy{n}") for n, c in enumerate(xy)],
    )
    return sums.select(
        *keys, "first_day", "last_day", "days", "units", "rows",
        F.array(*[f"xx{n}" for n in range(len(xx))]).alias("xx"), F.array(*[f"xy{n}" for n in range(len(xy))]).alias("xy"),
    )


def forecast_additive(
    history: DataFrame, keys: list[str] = KEYS, bends: int = 3, order: int = 3, bend_penalty: float = 10.0, season_penalty: float = 1.0
) -> DataFrame:
    """Units of the next 30 days per key, every day at least 0, rounded to one place, with the usual confidence.

    The season counts weekdays, the trend days from the key's first one. A key with a single day, or whose equations have
    no solution, gets its daily average, as the other models do.
    """
    sums = normal_equations(history, keys, bends, order)
    names = design(bends, order)
    penalty = np.array([0.0, 0.0, *[bend_penalty] * bends, *[season_penalty] * (2 * order)])
    upper = np.triu_indices(len(names))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n = len(batch)
            system = np.zeros((n, len(names), len(names)))
            system[:, upper[0], upper[1]] = np.stack(batch["xx"].to_numpy())
            system = system + np.triu(system, 1).transpose(0, 2, 1) + np.diag(penalty)
            right = np.stack(batch["xy"].to_numpy())
            first, last = pd.to_datetime(batch["first_day"]), pd.to_datetime(batch["last_day"])
            length = (last - first).dt.days.to_numpy(dtype=float)
            ahead = np.arange(1, HORIZON + 1)
            weekday = (last.dt.weekday.to_numpy()[:, None] + ahead) % 7
            future = _matrix(length[:, None] + ahead, np.maximum(length, 1.0)[:, None], weekday.astype(float), bends, order)
            good = (np.linalg.cond(system) < 1e12) & (length > 0)
            weights = np.zeros_like(right)
            if good.any():
                weights[good] = np.linalg.solve(system[good], right[good][:, :, None])[:, :, 0]
            fitted = np.maximum(np.einsum("nhp,np->nh", future, weights), 0.0).sum(axis=1)
            average = (batch["units"] / batch["rows"]).to_numpy(dtype=float) * HORIZON
            yield batch[keys].assign(units=np.where(good, fitted, average), days=batch["days"])

    kinds = dict(sums.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", units double, days long"
    solved = sums.mapInPandas(solve, schema)
    return solved.select(*keys, F.round("units", 1).alias("forecast_30d_units"), data_confidence(F.col("days")).alias("confidence"))
