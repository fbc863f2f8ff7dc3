"""An append-only log that notices when what was appended before is changed, removed or added to.

Every append writes a folder of its own and a manifest: the digest of each file, and a seal, the digest of the seal
before and these digests. Appending first checks the whole log against its manifests, so a rewritten past stops the next
append. Files are digested by Spark, one task reading a few files at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import path_exists

APPEND = "append"
MANIFEST = "file string, length long, digest string"
SEALS = f"{APPEND} long, before string, seal string"


class LogChanged(ValueError):
    """The log is not what was appended."""


class SealedLog:
    """Rows below `path`/rows, manifests below `path`/manifest, seals below `path`/seals."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _number(self) -> int:
        """How many appends there were."""
        return self._seals().agg(F.coalesce(F.max(APPEND) + 1, F.lit(0)).cast("long")).first()[0]

    def _seals(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/seals/*.parquet"):
            return self.spark.createDataFrame([], SEALS)
        return self.spark.read.schema(SEALS).parquet(f"{self.path}/seals")

    def _digests(self, folder: str, contents: bool) -> DataFrame:
        """(append, file, length, digest) of the files there are; without `contents` files are not read and have no digest."""
        if not path_exists(self.spark, f"{folder}/*"):
            return self.spark.createDataFrame([], f"{APPEND} long, {MANIFEST}")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        digest = F.sha2("content", 256) if contents else F.lit(None).cast("string")
        number = F.regexp_extract("path", f"{APPEND}=(\\d+)/[^/]*$", 1).cast("long")
        return files.select(number.alias(APPEND), F.element_at(F.split("path", "/"), -1).alias("file"), "length", digest.alias("digest"))

    @staticmethod
    def _sealed(before: Column, digests: Column) -> Column:
        return F.sha2(F.concat(before, F.array_join(F.sort_array(digests), ",")), 256)

    def append(self, rows: DataFrame, contents: bool = True) -> None:
        """Add rows after the past has been checked (see `check`). Columns are the log's own."""
        if rows.columns != self.spark.createDataFrame([], self.schema).columns:
            raise ValueError("rows do not match the log's columns")
        self.check(contents)
        number = self._number()
        folder = f"{self.path}/rows/{APPEND}={number}"
        # what an append that broke off before its seal has left is not part of the log
        rows.write.mode("overwrite").parquet(folder)
        self._digests(folder, True).select(*(c.split()[0] for c in MANIFEST.split(", "))).write.mode("overwrite").parquet(f"{self.path}/manifest/{APPEND}={number}")
        before = self._seals().where(F.col(APPEND) == number - 1).select("seal").first()
        made = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{APPEND}={number}")
        last = F.lit(before[0] if before else "")
        seal = made.agg(F.collect_list("digest").alias("d")).select(F.lit(number).cast("long").alias(APPEND), last.alias("before"), self._sealed(last, F.col("d")).alias("seal"))
        seal.coalesce(1).write.mode("append").parquet(f"{self.path}/seals")

    def _manifest(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/manifest/*/*.parquet"):
            return self.spark.createDataFrame([], f"{MANIFEST}, {APPEND} long")
        return self.spark.read.schema(f"{MANIFEST}, {APPEND} long").parquet(f"{self.path}/manifest")

    def problems(self, contents: bool = True) -> DataFrame:
        """(append, file, problem): files changed, missing or added, and seals that do not follow from what they seal.

        Without `contents` files are compared by name and length only.
        """
        seals = self._seals()
        listed = self._manifest().join(seals.select(APPEND), APPEND, "left_semi")
        there = self._digests(f"{self.path}/rows", contents).join(seals.select(APPEND), APPEND, "left_semi")
        there = there.select(APPEND, "file", F.col("length").alias("l"), F.col("digest").alias("d"))
        both = listed.join(there, [APPEND, "file"], "full")
        differs = (F.col("l") != F.col("length")) | (F.col("d") != F.col("digest"))
        kind = F.when(F.col("length").isNull(), "added").when(F.col("l").isNull(), "missing").when(differs, "changed")
        files = both.select(APPEND, "file", kind.alias("problem")).where("problem IS NOT NULL")
        digests = listed.groupBy(APPEND).agg(F.collect_list("digest").alias("d"))
        earlier = seals.select((F.col(APPEND) + 1).alias(APPEND), F.col("seal").alias("last"))
        chain = seals.join(digests, APPEND, "left").join(earlier, APPEND, "left")
        good = (F.col("before") == F.coalesce("last", F.lit(""))) & (F.col("seal") == self._sealed(F.col("before"), F.coalesce("d", F.array().cast("array<string>"))))
        broken = chain.where(~good).select(APPEND, F.lit(None).cast("string").alias("file"), F.lit("seal").alias("problem"))
        return files.unionByName(broken)

    def check(self, contents: bool = True) -> None:
        """Raise `LogChanged` with the first problems if the past is not as it was sealed."""
        found = self.problems(contents).orderBy(APPEND, "file").limit(5).collect()
        if found:
            raise LogChanged("; ".join(f"append {r[APPEND]}: {r['file'] or 'record'} {r['problem']}" for r in found))

    def read(self) -> DataFrame:
        """All sealed rows."""
        if self._number() == 0:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, {APPEND} long").parquet(f"{self.path}/rows")
        return rows.join(self._seals().select(APPEND), APPEND, "left_semi").drop(APPEND)
