"""Table sinks: overwrite, append-only log, keyed updates, publishing, bootstrap, provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..session import scratch_path, staged
from .files import path_exists


def overwrite(df: DataFrame, target: str) -> None:
    """Replace rows and schema of a Parquet folder."""
    df.write.mode("overwrite").option("overwriteSchema", "true").parquet(target)


def append_log(df: DataFrame, target: str, spark: SparkSession) -> None:
    """Add rows to a log. The writer has no other mode; columns must equal those already there."""
    if path_exists(spark, f"{target}/*.parquet"):
        known = spark.read.parquet(target).schema
        if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("rows do not match the log's columns")
    df.write.mode("append").parquet(target)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop objects: driver-side renames on any store Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """How the names of the folders below `path` that begin with `prefix` go on; names only, no job."""
    files, place = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]


def has_folder(spark: SparkSession, path: str, prefix: str) -> bool:
    """Whether a folder below `path` has a name that begins with `prefix`."""
    return bool(folders(spark, path, prefix))


def _beside(place, name: str):
    """A path next to `place`; a leading dot hides it from readers of the parent folder."""
    return place.suffix("").getParent().suffix(f"/{name}")


def recover(spark: SparkSession, target: str) -> None:
    """Finish or undo a switch that broke off: without a live folder the previous version comes back."""
    files, place = _files(spark, target)
    old = _beside(place, f".old.{place.getName()}")
    if files.exists(old):
        if files.exists(place):
            files.delete(old, True)
        elif not files.rename(old, place):
            raise OSError(f"{old} could not be moved back")


def switch(spark: SparkSession, made: str, target: str) -> None:
    """Put the finished folder `made` in the place of `target` by renames.

    Both versions are complete all the time. A reader that comes between the two renames finds no table; `recover`,
    which every writer here calls first, then brings the old version back.
    """
    recover(spark, target)
    files, place = _files(spark, target)
    old, new = _beside(place, f".old.{place.getName()}"), _files(spark, made)[1]
    if files.exists(place) and not files.rename(place, old):
        raise OSError(f"{place} could not be set aside")
    if not files.rename(new, place):
        raise OSError(f"{new} could not be moved to {place}")
    if files.exists(old):
        files.delete(old, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    files, place = _files(spark, path)
    files.delete(place, True)


#: Settings inside `passing`. Spark removes a statement's shuffle files when the statement is done, and not when the driver
#: collects garbage. It broadcasts no side of a join unasked: by the size of packed files a side with millions of rows is small,
#: and the driver has to hold them.
PASSING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `staged` for results that only the statements inside use: they go at the end, shuffle files after each statement.

    Only what a statement marks with `F.broadcast` is broadcast.
    """
    path, before = scratch_path(spark, name), {k: spark.conf.get(k, None) for k in PASSING}

    def stage(df: DataFrame, part: str) -> DataFrame:
        made = f"{path}/{part}-{uuid4().hex}"
        df.write.option("compression", "zstd").parquet(made)
        return spark.read.schema(df.schema).parquet(made)

    try:
        for key, value in PASSING.items():
            spark.conf.set(key, value)
        yield stage
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        remove(spark, path)


def replace_table(df: DataFrame, target: str, partition: str | None = None) -> None:
    """Write a table's next version, which may read from the table itself, beside it and then switch to it.

    With `partition`, only the partitions present in `df` are replaced, one switch each. Rows are written once, and
    nothing stays behind.
    """
    spark = df.sparkSession
    _, place = _files(spark, target)
    made = _beside(place, f".next.{place.getName()}.{uuid4().hex}").toString()
    try:
        if partition is None:
            df.write.parquet(made)
            switch(spark, made, target)
            return
        df.write.partitionBy(partition).parquet(made)
        files, folder = _files(spark, made)
        for found in files.listStatus(folder):
            name = found.getPath().getName()
            if found.isDirectory() and "=" in name:
                switch(spark, f"{made}/{name}", f"{target.rstrip('/')}/{name}")
    finally:
        files, folder = _files(spark, made)
        if files.exists(folder):
            files.delete(folder, True)


def upsert_table(
    spark: SparkSession, target: str, source: DataFrame, keys: list[str], order: list[str] | None = None, partition: str | None = None
) -> None:
    """Upsert into a Parquet table by the target's own schema (see `maintenance.upsert`).

    With `partition` (a column a key never changes), only the partitions the source touches are read and rewritten.
    Two source rows of one key need an `order`.
    """
    recover(spark, target)
    current = spark.read.parquet(target)
    if partition:
        # a partition column is read back with a type guessed from folder names
        current = current.withColumn(partition, F.col(partition).cast(source.schema[partition].dataType))
        current = current.join(source.select(partition).distinct(), partition, "left_semi")
    replace_table(maintenance.upsert(current, source, keys, order), target, partition)


def insert_new_rows(spark: SparkSession, target: str, source: DataFrame, keys: list[str]) -> None:
    """Append the source rows whose key the table lacks; a rerun adds nothing."""
    recover(spark, target)
    current = spark.read.schema(source.schema).parquet(target)
    staged(maintenance.insert_new(current, source, keys), "new-rows").write.mode("append").parquet(target)


def publish_snapshot(df: DataFrame, target: str, jdbc: dict | None = None, batch: int = 500) -> None:
    """Full copy of a result to a serving folder, or to a database given JDBC options (url, dbtable, ...)."""
    if jdbc is None:
        overwrite(df, target)
    else:
        df.write.format("jdbc").options(batchsize=batch, **jdbc).mode("overwrite").save()


def create_if_missing(spark: SparkSession, table: str, columns: str) -> None:
    """Idempotent table bootstrap, with its schema when the name is qualified."""
    if "." in table:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING PARQUET")


def provenance(spark: SparkSession, dataset: str, credentialed: bool, has_notes: bool, license_text: str) -> DataFrame:
    """One row on where a dataset came from and when it was loaded."""
    row = spark.createDataFrame(
        [(dataset, credentialed, has_notes, license_text)],
        "dataset string, credentialed boolean, has_notes boolean, license string",
    )
    return row.withColumn("loaded_at", F.current_timestamp())
