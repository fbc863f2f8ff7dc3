"""Predicates, facets, bands, ranks, search and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def optional(df: DataFrame, column: str, value, every="All") -> DataFrame:
    """Equality filter that is left out when the value is the sentinel or None."""
    return df if value is None or value == every else df.where(F.col(column) == value)


def facets(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """IN-list filters joined with AND; empty lists are left out."""
    return df.where(all_of([F.col(c).isin(list(v)) for c, v in chosen.items() if v]))


def search_any(df: DataFrame, columns: list[str], text: str | None, chosen: dict[str, list] | None = None) -> DataFrame:
    """Case-insensitive substring in any of the columns, plus exact facets."""
    out = facets(df, chosen or {})
    needle = (text or "").strip().lower()
    if not needle:
        return out
    return out.where(any_of([F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns]))


def typeahead(df: DataFrame, column: str, prefix: str, n: int, ties: list[str]) -> DataFrame:
    """The first `n` rows whose column starts with the prefix, any case. No wildcards apply."""
    return df.where(F.lower(F.col(column)).startswith(prefix.lower())).orderBy(column, *ties).limit(n)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(column).distinct().orderBy(column)


def ladder(steps: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """First condition that holds gives the label."""
    out = reduce(lambda w, s: w.when(s[0], s[1]), steps[1:], F.when(steps[0][0], steps[0][1]))
    return out.otherwise(otherwise) if otherwise is not None else out


def right_closed_bands(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the band (edge[i], edge[i+1]]; NULL outside all bands."""
    steps = [
        ((value > lo) & (value <= hi), label) for lo, hi, label in zip(edges[:-1], edges[1:], labels)
    ]
    return ladder(steps, None)


def tens(value: Column) -> Column:
    """Lower end of the ten-wide band."""
    return (F.floor(value / 10) * 10).cast("int")


def rank_of(column: Column, ordered: list[str]) -> Column:
    """Position in the list; values outside it come last."""
    steps = F.when(column == ordered[0], 0)
    for i, v in enumerate(ordered[1:], start=1):
        steps = steps.when(column == v, i)
    return steps.otherwise(len(ordered))


def censored_on_time(created: Column, closed: Column, target_days: Column, now: Column) -> Column:
    """True or false once decided; NULL while open and not yet due."""
    due = F.timestamp_add("DAY", target_days, created)
    return F.when(closed.isNotNull(), closed <= due).when(now > due, F.lit(False))


def dimension(name: str, allowed: dict[str, Column]) -> Column:
    """Column for a user-chosen label; anything off the list raises."""
    if name not in allowed:
        raise ValueError(f"unknown dimension {name!r}; choose from {sorted(allowed)}")
    return allowed[name]


def thread_role(admin_id: str = "admin_id") -> Column:
    """'admin' where the message has an admin, otherwise 'customer'."""
    return F.when(F.col(admin_id).isNotNull(), "admin").otherwise("customer")


EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def violations(
    allowed: dict[str, list[str]] | None = None,
    minimum: dict[str, int] | None = None,
    required: list[str] | None = None,
    emails: list[str] | None = None,
) -> Column:
    """Names of the columns that break a rule, as a sorted array. Optional columns may be NULL."""
    checks: list[tuple[str, Column]] = []
    checks += [(c, F.coalesce(~F.col(c).isin(list(v)), F.lit(False))) for c, v in (allowed or {}).items()]
    checks += [(c, F.coalesce(F.col(c) < v, F.lit(False))) for c, v in (minimum or {}).items()]
    checks += [(c, F.col(c).isNull() | (F.length(F.col(c).cast("string")) == 0)) for c in (required or [])]
    checks += [(c, ~F.coalesce(F.col(c).rlike(EMAIL_SHAPE), F.lit(True))) for c in (emails or [])]
    listed = F.array(*[F.when(bad, F.lit(c)) for c, bad in checks])
    return F.array_sort(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())))


def quarantine(df: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    marked = df.withColumn("violations", broken)
    return (
        marked.where(F.size("violations") == 0).drop("violations"),
        marked.where(F.size("violations") > 0),
    )
