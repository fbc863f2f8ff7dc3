"""Serving copies that are brought up to date by the difference to the next version.

The copy keeps a hash of every row beside its key. Publishing reads keys and hashes of the copy, not its rows, compares
them with the new version from both sides, and stores inserts, updates and deletes as one more version; rows
that did not change are neither moved to the copy nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hotkeys import same_keys
from ..session import staged
from ..streaming.incremental import VERSION
from ..streaming.maintained import KeyedVersions
from . import tables

OPERATION, ROW_HASH = "operation", "row_hash"


def row_hash(columns: list[str]) -> Column:
    """128 bits of all columns; NULLs and their places count."""
    marked = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.concat(F.hex(F.xxhash64(*marked)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *marked)))


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(columns of `new`, operation, row_hash): what turns `old` into `new`; keys are unique on either side.

    `old` needs the keys and row_hash only. Deleted rows have their key and NULLs.
    """
    columns = new.columns
    fresh = new.withColumn(ROW_HASH, row_hash(columns))
    known = old.select(*keys, F.col(ROW_HASH).alias("__old"))
    both = same_keys(fresh, known, keys, "left")
    changed = both.where(F.col("__old").isNull() | (F.col("__old") != F.col(ROW_HASH)))
    kind = F.when(F.col("__old").isNull(), "insert").otherwise("update").alias(OPERATION)
    gone = same_keys(known, new.select(*keys), keys, "left_anti")
    nothing = [F.col(c) if c in keys else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in columns]
    deleted = gone.select(*nothing, F.lit("delete").alias(OPERATION), F.lit(None).cast("string").alias(ROW_HASH))
    return changed.select(*columns, kind, ROW_HASH).unionByName(deleted)


class PublishedCopy:
    """A keyed serving copy below `path`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.columns = spark, path, keys, schema.names
        # a deleted row has NULL in every column but the key
        loose = [T.StructField(f.name, f.dataType) for f in schema]
        whole = T.StructType([*loose, T.StructField(OPERATION, T.StringType()), T.StructField(ROW_HASH, T.StringType())])
        self.table = KeyedVersions(spark, path, whole, keys, keys, buckets)

    def _next(self) -> int:
        if not tables.has_folder(self.spark, self.path, f"{VERSION}="):
            return 0
        return self.spark.read.parquet(self.path).agg(F.max(VERSION)).first()[0] + 1

    def publish(self, new: DataFrame, apply: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Make the copy equal to `new`; returns the difference that was stored.

        `apply` gets the difference first, to bring an outside copy along; it may get it again if the run fails after
        that, so it should write by key.
        """
        changes = staged(difference(self._live(), new.select(*self.columns), self.keys), "difference")
        if apply is not None:
            apply(changes)
        if not changes.isEmpty():
            self.table.write(changes, self._next())
        return changes

    def _live(self) -> DataFrame:
        return self.table.current().where(F.col(OPERATION) != "delete")

    def current(self) -> DataFrame:
        """The copy's rows."""
        return self._live().select(*self.columns)
