"""Per-group demand forecasts and replenishment quantities.

A history is one row per key and day: keys, `sale_date`, `units_sold`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["store_id", "product_id"]
HORIZON = 30


def daily_history(sales: DataFrame, keys: list[str], as_of: Column, days: int = 90) -> DataFrame:
    """Units per key and day within the trailing days: at most `days + 1` rows per key and no more."""
    recent = sales.where((F.col("sale_date") >= F.date_sub(as_of, days)) & (F.col("sale_date") <= as_of))
    return recent.groupBy(*keys, "sale_date").agg(F.sum("units_sold").alias("units_sold"))


def data_confidence(days: Column) -> Column:
    """high from 60 days of history, medium from 30, otherwise low."""
    return F.when(days >= 60, "high").when(days >= 30, "medium").otherwise("low")


def anchored(history: DataFrame, keys: list[str]) -> DataFrame:
    """Add `days_ago`, counted from the last date of the row's own key."""
    anchors = history.groupBy(*keys).agg(F.max("sale_date").alias("__anchor"))
    return history.join(anchors, keys).withColumn("days_ago", F.datediff("__anchor", "sale_date")).drop("__anchor")


def forecast_wma(history: DataFrame, keys: list[str] = KEYS, weeks: int = 4, cap_history: bool = False) -> DataFrame:
    """Weighted moving average over week buckets, newest week heaviest, as 30-day units.

    Days older than `weeks` weeks fall into the last bucket, which is still divided by seven days, so
    long histories come out high; `cap_history` drops those days instead. Empty weeks carry no weight.
    """
    dated = anchored(history, keys)
    if cap_history:
        days = dated.groupBy(*keys).agg(F.countDistinct("sale_date").alias("__days"))
        dated = dated.where(F.col("days_ago") < 7 * weeks)
    bucket = F.least(F.floor(F.col("days_ago") / 7), F.lit(weeks - 1)).cast("int")
    per_week = dated.groupBy(*keys, bucket.alias("__week")).agg(
        F.sum("units_sold").alias("__units"), F.countDistinct("sale_date").alias("__days")
    )
    weight = F.lit(weeks) - F.col("__week")
    daily = F.try_divide(F.sum(F.col("__units") * weight).cast("double"), F.sum(weight * 7))
    out = per_week.groupBy(*keys).agg(
        F.round(F.coalesce(daily, F.lit(0.0)) * HORIZON, 1).alias("forecast_30d_units"),
        F.sum("__days").alias("__days"),
    )
    if cap_history:
        out = out.drop("__days").join(days, keys)
    return out.withColumn("confidence", data_confidence(F.col("__days"))).drop("__days")


def serving_features(history: DataFrame, keys: list[str] = KEYS, windows: tuple[int, ...] = (7, 30, 60, 90)) -> DataFrame:
    """Units in windows counted back from each key's own last date, that date and day n included."""
    sums = [
        F.sum(F.when(F.col("days_ago") <= n, F.col("units_sold")).otherwise(0)).cast("double").alias(f"units_{n}d")
        for n in windows
    ]
    out = anchored(history, keys).groupBy(*keys).agg(*sums)
    return out.withColumn("avg_daily_30d", F.round(F.col("units_30d") / 30.0, 4))


def holt_winters_sum(y: np.ndarray, period: int, horizon: int) -> float:
    """Sum of the next `horizon` values of an additive, damped-trend, seasonal smoother.

    All candidate parameter sets run side by side as vectors; a second, finer grid is laid around the
    best one. Chosen by squared one-step error.
    """
    def fit(alpha, beta, gamma, phi):
        grid = np.array(np.meshgrid(alpha, beta, gamma, phi)).reshape(4, -1)
        a, b, g, p = grid
        n = a.size
        level = np.full(n, y[:period].mean())
        trend = np.full(n, (y[period : 2 * period].mean() - y[:period].mean()) / period)
        season = np.repeat((y[:period] - y[:period].mean())[:, None], n, axis=1)
        loss = np.zeros(n)
        for t, value in enumerate(y):
            s = season[t % period].copy()
            step = level + p * trend
            loss += (value - step - s) ** 2
            new_level = a * (value - s) + (1 - a) * step
            trend = b * (new_level - level) + (1 - b) * p * trend
            season[t % period] = g * (value - new_level) + (1 - g) * s
            level = new_level
        best = int(loss.argmin())
        damp = np.cumsum(p[best] ** np.arange(1, horizon + 1))
        ahead = season[(len(y) + np.arange(horizon)) % period, best]
        return grid[:, best], float((level[best] + damp * trend[best] + ahead).sum())

    coarse, _ = fit([0.05, 0.2, 0.5, 0.8], [0.01, 0.1, 0.3], [0.01, 0.1, 0.3], [0.8, 0.9, 0.98])
    near = [np.clip(c * np.array([0.6, 1.0, 1.4]), 1e-4, 0.99) for c in coarse[:3]]
    _, out = fit(*near, [max(0.8, coarse[3] - 0.04), coarse[3], min(0.98, coarse[3] + 0.04)])
    return out


def _seasonal_units(daily: pd.Series, rows: int, period: int) -> float:
    """Seasonal forecast given two periods of rows; the average otherwise and when a fit fails."""
    if rows >= 2 * period and len(daily) >= 2 * period:
        units = holt_winters_sum(daily.to_numpy(dtype=float), period, HORIZON)
        if np.isfinite(units):
            return max(0.0, round(units, 1))
    return round(float(daily.mean()) * HORIZON, 1)


def forecast_holt_winters(
    history: DataFrame, keys: list[str] = KEYS, period: int = 7, as_of: Column | None = None, days: int = 90
) -> DataFrame:
    """Weekly-seasonal smoothing with damped trend, per key, missing days counted as zero.

    A group handed to Python is one key's daily rows inside the trailing window: at most days + 1.
    """
    newest = as_of if as_of is not None else history.agg(F.max("sale_date").alias("d")).scalar()
    return forecast_pluggable(
        daily_history(history, keys, newest, days),
        lambda daily, rows: _seasonal_units(daily, rows, period),
        keys,
    )


def forecast_pluggable(history: DataFrame, model: Callable[[pd.Series, int], float], keys: list[str] = KEYS) -> DataFrame:
    """Run `model(daily units with gaps as 0, number of rows) -> 30-day units` per key.

    Give it a `daily_history` frame, whose groups are bounded. A model that raises falls back to the
    daily average.
    """
    types = dict(history.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", forecast_30d_units double, __days long"

    def per_key(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        daily = pd.Series(
            group["units_sold"].to_numpy(dtype=float), index=pd.to_datetime(group["sale_date"])
        ).resample("D").sum()
        try:
            units = model(daily, len(group))
        except Exception:
            units = round(float(daily.mean()) * HORIZON, 1)
        return pd.DataFrame([[*key, float(units), group["sale_date"].nunique()]], columns=[*keys, "forecast_30d_units", "__days"])

    out = history.groupBy(*keys).applyInPandas(per_key, schema)
    return out.withColumn("confidence", data_confidence(F.col("__days"))).drop("__days")


# Names a job may select. Models beyond these come in through `forecast_pluggable`.
MODELS: dict[str, Callable[..., DataFrame]] = {
    "weighted_moving_average": forecast_wma,
    "exponential_smoothing": forecast_holt_winters,
}


def forecast(name: str, history: DataFrame, keys: list[str] = KEYS, plugged: dict[str, Callable] | None = None) -> DataFrame:
    """Forecast by model name; `plugged` maps further names to model callables."""
    if name == "additive":
        from .additive import forecast_additive

        return forecast_additive(history, keys)
    if name in MODELS:
        return MODELS[name](history, keys)
    if name in (plugged or {}):
        return forecast_pluggable(history, plugged[name], keys)
    raise ValueError(f"unknown forecast model {name!r}; choose from {sorted(["additive", *MODELS, *(plugged or {})])}")


def replenishment(forecasts: DataFrame, stock: DataFrame, products: DataFrame, model: str, generated_at: Column) -> DataFrame:
    """Order quantity: forecast plus the reorder quantity, less stock on hand and on order, at least 0.

    Rounds half to even. `stock` has store_id, product_id, quantity_on_hand, quantity_on_order;
    `products` has product_id, reorder_quantity. Store the result with `maintenance.upsert`.
    """
    zero = F.lit(0)
    need = (
        F.col("forecast_30d_units")
        + F.coalesce("reorder_quantity", zero)
        - F.coalesce("quantity_on_hand", zero)
        - F.coalesce("quantity_on_order", zero)
    )
    return (
        forecasts.join(stock.select(*KEYS, "quantity_on_hand", "quantity_on_order"), KEYS, "left")
        .join(products.select("product_id", "reorder_quantity"), "product_id", "left")
        .select(
            *KEYS,
            "forecast_30d_units",
            "confidence",
            F.bround(F.greatest(need, F.lit(0.0)), 0).cast("int").alias("recommended_order_qty"),
            F.lit(model).alias("model_used"),
            generated_at.alias("generated_at"),
        )
    )
