"""File sources: change histories, CSV in either compression, listings, notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cdc import ChangeSpec


def read_change_log(
    spark: SparkSession, path: str, schema: T.StructType, stream: bool = False, spec: ChangeSpec | None = None, files: str | None = None
) -> DataFrame:
    """An append-only change history as a batch or streaming DataFrame, checked for the spec's columns.

    `files` is a pattern for the names of the files to read.
    """
    if spec:
        missing = {*spec.keys, *spec.sequence, spec.operation} - set(schema.names)
        if missing:
            raise ValueError(f"change history lacks {sorted(missing)}")
    reader = spark.readStream if stream else spark.read
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    return reader.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does anything match the path? Works on every file system Spark reads."""
    listing = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
    try:
        return not listing.load(path).select("path").isEmpty()
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return False
        raise


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that is there."""
    return next((p for p in paths if path_exists(spark, p)), None)


def csv_path(spark: SparkSession, root: str, name: str) -> str | None:
    """Where the CSV `name` lies under `root`: compressed if there is such a file, else plain."""
    base = f"{root.rstrip('/')}/{name}.csv"
    return first_existing(spark, [f"{base}.gz", base])


def _csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """A CSV with a header row and doubled quotes: every column is text, names are lower case."""
    options = {"header": True, "escape": '"', "multiLine": multiline}
    rows = spark.read.options(**options).csv(path)
    return rows.withColumnsRenamed({c: c.lower() for c in rows.columns})


def read_csv_any(spark: SparkSession, root: str, name: str, multiline: bool = False) -> DataFrame:
    """The CSV `name` under `root` in either form; FileNotFoundError without one."""
    path = csv_path(spark, root, name)
    if path is None:
        raise FileNotFoundError(f"{root} has no CSV file {name}, compressed or not")
    return _csv(spark, path, multiline)


def read_optional_union(spark: SparkSession, root: str, names: list[str], multiline: bool = True) -> DataFrame:
    """The files that exist, stacked by column name; missing columns are NULL."""
    paths = [p for n in names if (p := csv_path(spark, root, n))]
    if not paths:
        raise FileNotFoundError(f"{root} has none of the CSV files {', '.join(names)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_csv(spark, p, multiline) for p in paths])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and modified time of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def preview(df: DataFrame, order: list[str], rows: int = 5000, most: int = 10_000) -> DataFrame:
    """The first rows in a fixed order, as many as asked for but no more than `most`."""
    return df.orderBy(*order).limit(min(int(rows), most))
