"""Keyed-table maintenance as whole-table expressions.

Each function returns the table's next version as a DataFrame; `sources.tables` writes it.
Catalogs with MERGE can use `merge_into` instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest_row


def one_per_key(source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The source with unique keys: the newest row by `order`. Without an order, a second row of a key fails the job.

    Rows with a NULL in the key match nothing and stay as they are.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed, loose = source.where(whole), source.where(~whole)
    if order:
        return latest_row(keyed, keys, order).unionByName(loose)
    packed = keyed.groupBy(*keys).agg(F.any_value(F.struct(*source.columns)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    problem = F.raise_error(F.concat(F.lit("several source rows with key "), F.to_json(F.struct(*keys))))
    single = packed.select(F.when(F.col("__n") == 1, F.col("__row")).otherwise(problem.cast(packed.schema["__row"].dataType)).alias("__row"))
    return single.select("__row.*").unionByName(loose)


def check_columns(target: DataFrame, source: DataFrame) -> None:
    """The source may lack columns of the target; it has no others, and the types agree."""
    known = {f.name: f.dataType for f in target.schema}
    for f in source.schema:
        if f.name not in known:
            raise ValueError(f"the target has no column {f.name}")
        if f.dataType != known[f.name]:
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()} in the source and {known[f.name].simpleString()} in the target")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Matched keys take the source row, new keys are added, the rest stay.

    Columns that the source lacks keep their value on matched keys and are NULL on new ones. Of further columns, the
    source may have those of `order`.
    """
    ranking = [c for c in order or [] if c not in target.columns]
    check_columns(target, source.drop(*ranking))
    incoming = one_per_key(source, keys, order).drop(*ranking)
    missing = [f for f in target.schema if f.name not in source.columns]
    kept = target.join(incoming.select(*keys), keys, "left_anti").select(*target.columns)
    if not missing:
        return kept.unionByName(incoming.select(*target.columns))
    old = target.select(*keys, F.struct(*[f.name for f in missing]).alias("__old"))
    widened = incoming.join(old, keys, "left")
    columns = [F.col(f"__old.{f.name}").cast(f.dataType).alias(f.name) if f in missing else F.col(f.name) for f in target.schema]
    return kept.unionByName(widened.select(*columns))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Only the source rows whose key the target lacks: append these."""
    return source.join(target.select(*keys), keys, "left_anti").select(*source.columns)


def update_by_key(target: DataFrame, changes: DataFrame, keys: list[str], sets: dict[str, Column]) -> DataFrame:
    """Matched rows take the computed values; others stay.

    Expressions read the target's columns by name and the change's columns as `new.<column>`.
    """
    packed = changes.select(*keys, F.struct("*").alias("new"))
    joined = target.join(packed, keys, "left")
    hit = F.col("new").isNotNull()
    types = dict(target.dtypes)
    changed = {c: F.when(hit, e).otherwise(F.col(c)).cast(types[c]).alias(c) for c, e in sets.items()}
    return joined.select(*[changed.get(c, F.col(c)) for c in target.columns])


def partial_update(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Patch: a NULL in the change leaves the old value."""
    sets = {c: F.coalesce(F.col(f"new.{c}"), F.col(c)) for c in columns}
    return update_by_key(target, changes, keys, sets)


def delete_by_key(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """The target without the listed keys."""
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def delete_from_time(
    parents: DataFrame, children: DataFrame, group: str, ts: str, cuts: DataFrame, parent_key: str, child_key: str
) -> tuple[DataFrame, DataFrame]:
    """Drop parents of a group at or after the group's cut time, and the children of dropped parents.

    `cuts` has columns (group, cut). Returns (parents, children) as they remain.
    """
    doomed = (
        parents.join(cuts, group).where(F.col(ts) >= F.col("cut")).select(F.col(parent_key).alias(child_key)).distinct()
    )
    kept = parents.join(cuts, group, "left").where(F.col("cut").isNull() | (F.col(ts) < F.col("cut")))
    return kept.select(*parents.columns), delete_by_key(children, doomed, [child_key])


def guarded_insert(source: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Only the source rows whose (owned) parent exists: append these."""
    return source.join(parents.select(*on), on, "left_semi").select(*source.columns)


def merge_into(target: str, source: DataFrame, keys: list[str], update: bool = True) -> None:
    """MERGE for catalogs whose tables support it: insert new keys, and update matched ones if asked."""
    on = F.expr(" AND ".join(f"{target}.{k} = s.{k}" for k in keys))
    merge = source.alias("s").mergeInto(target, on)
    if update:
        merge = merge.whenMatched().updateAll()
    merge.whenNotMatched().insertAll().merge()
