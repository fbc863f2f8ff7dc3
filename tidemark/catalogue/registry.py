"""Entries: a Spark query, its result columns, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hotkeys import HotKeys, hot_keys
from ..session import staged
from .views import BASE, VIEWS

# Column kinds: Spark type, SQL type.
KINDS = {
    "b": ("bigint", "BIGINT"),
    "s": ("string", "VARCHAR"),
    "t": ("timestamp_ntz", "TIMESTAMP"),
    "D": ("date", "DATE"),
    "B": ("boolean", "BOOLEAN"),
}


class Tables:
    """The driver's tables, and the domain views laid over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}
        self._hot: dict[str, HotKeys] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._load(name)
        return self._known[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = VIEWS[name]
        return self.spark.sql(text, **{d: self[d] for d in _references(text)})

    def __getattr__(self, name: str) -> DataFrame:
        return self[name]

    def hot(self, name: str, keys: list[str]) -> HotKeys:
        """Hot keys of a table, looked up once per query."""
        found = f"{name}:{','.join(keys)}"
        if found not in self._hot:
            self._hot[found] = hot_keys(self[name], keys)
        return self._hot[found]

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """An intermediate result that a query uses several times: built and written once, then read."""
        key = f"once:{name}"
        if key not in self._known:
            self._known[key] = staged(build(), name)
        return self._known[key]


def _references(text: str) -> list[str]:
    return sorted({name for name in re.findall(r"\{(\w+)\}", text) if name in VIEWS or name in BASE})


def _needed(text: str, seen: dict[str, str]) -> dict[str, str]:
    """Views a text refers to, each after those it builds on."""
    for name in _references(text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen[name] = VIEWS[name]
    return seen


def _plain(text: str) -> str:
    """The text with table names out of their braces; other braces, as in patterns, stay."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in VIEWS or m[1] in BASE else m[0], text)


@dataclass(frozen=True)
class Entry:
    """`columns` is "name:kind ..."; kind d<n> is a double rounded to n places."""

    name: str
    columns: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def kinds(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        out = []
        for name, kind in self.kinds():
            if kind.startswith("d"):
                out.append((F.round(F.col(name).cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name))
            else:
                out.append(F.col(name).cast(KINDS[kind][0]).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cast = []
        for name, kind in self.kinds():
            if kind.startswith("d"):
                cast.append(f"ROUND(CAST({name} AS DOUBLE), {kind[1:]}) + 0.0 AS {name}")
            else:
                cast.append(f"CAST({name} AS {KINDS[kind][1]}) AS {name}")
        views = ",\n".join(f"{n} AS ({_plain(t)})" for n, t in _needed(self.sql, {}).items())
        head = f"WITH {views}\n" if views else ""
        return f"{head}SELECT {', '.join(cast)} FROM (\n{_plain(self.sql).strip()}\n) AS result"
