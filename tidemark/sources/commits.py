"""Several tables written by one decision, which readers see all together or not at all.

Every attempt to write a batch puts its rows of all tables into folders of its own. The commit record, written last,
names the attempt that holds for the batch; readers join with the records, so an attempt that broke off between two
tables is invisible. Writing a committed batch again does nothing; of two attempts that both commit, the first counts.
`repair` removes what broken attempts left.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .files import path_exists

ATTEMPT, BATCH = "attempt", "batch"
RECORDS = f"{BATCH} string, {ATTEMPT} string, committed_at timestamp"


class CommittedTables:
    """Tables below `path`, and the commit records that decide which of their rows count."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _records(self) -> DataFrame:
        """The attempt that counts per batch: the first to commit."""
        if not path_exists(self.spark, f"{self.path}/_records/*.parquet"):
            return self.spark.createDataFrame([], RECORDS)
        found = self.spark.read.schema(RECORDS).parquet(f"{self.path}/_records")
        return found.groupBy(BATCH).agg(F.min_by(ATTEMPT, F.struct("committed_at", ATTEMPT)).alias(ATTEMPT))

    def committed(self, batch: str) -> bool:
        return not self._records().where(F.col(BATCH) == batch).isEmpty()

    def write(self, batch: str, outputs: dict[str, DataFrame]) -> None:
        """Write one batch's rows of every table, then its record. A committed batch is left as it is."""
        if set(outputs) != set(self.schemas):
            raise ValueError(f"a batch writes {sorted(self.schemas)}")
        if self.committed(batch):
            return
        attempt = uuid4().hex
        for name, rows in outputs.items():
            self._put(name, batch, attempt, rows)
        self._commit(batch, attempt)

    def _put(self, name: str, batch: str, attempt: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        rows.select(*columns, F.lit(batch).alias(BATCH)).write.parquet(f"{self.path}/{name}/{ATTEMPT}={attempt}")

    def _commit(self, batch: str, attempt: str) -> None:
        record = self.spark.createDataFrame([(batch, attempt)], f"{BATCH} string, {ATTEMPT} string").withColumn("committed_at", F.current_timestamp())
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/_records")

    def read(self, name: str) -> DataFrame:
        """The committed rows of a table."""
        if not path_exists(self.spark, f"{self.path}/{name}/{ATTEMPT}=*"):
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(f"{self.schemas[name]}, {BATCH} string, {ATTEMPT} string").parquet(f"{self.path}/{name}")
        return rows.join(self._records(), [BATCH, ATTEMPT], "left_semi").drop(BATCH, ATTEMPT)

    def repair(self) -> int:
        """Delete the rows of attempts that do not count; returns how many folders went. No writer may be at work.

        Folder names come to the driver, one per attempt and table.
        """
        files, _ = tables._files(self.spark, self.path)
        counting = {r[ATTEMPT] for r in self._records().collect()}
        gone = 0
        for name in self.schemas:
            place = tables._files(self.spark, f"{self.path}/{name}")[1]
            if not files.exists(place):
                continue
            for found in files.listStatus(place):
                folder = found.getPath()
                if folder.getName().startswith(f"{ATTEMPT}=") and folder.getName().partition("=")[2] not in counting:
                    files.delete(folder, True)
                    gone += 1
        return gone
