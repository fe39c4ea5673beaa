"""Tables that streams write and readers see whole: each batch makes a version in a folder of its own, and a pointer moves.

A reader takes the version that the pointer names and reads nothing else, so that it never sees half a batch. The pointer
is a small file that a rename replaces at once. It names the batch, so that a batch that runs again after a failure, before
or after the pointer moved, leaves the table as if it had run once. The folders must be on a file system whose renames are
atomic (HDFS, a local disk); a store without them needs another pointer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay, so that a reader of the one before last still finds its files.
KEPT = 2


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._folder = self._fs.Path(path)
        self._system = self._folder.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _version(self, batch: int) -> str:
        return f"{self.path}/v-{batch:019d}"

    def batch(self) -> int | None:
        """The batch that the pointer names; none before the first."""
        if not self._system.exists(self._at("_current")):
            return None
        stream = self._system.open(self._at("_current"))
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The current version, or None before the first. A DataFrame once made stays with its version."""
        batch = self.batch()
        return None if batch is None else self.spark.read.parquet(self._version(batch))

    def _point(self, batch: int) -> None:
        new = self._at(f"_next-{uuid.uuid4().hex}")
        stream = self._system.create(new, True)
        stream.write(bytearray(str(batch).encode()))
        stream.close()
        context = self._fs.FileContext.getFileContext(self._folder.toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
        how[0] = getattr(self._fs, "Options$Rename").OVERWRITE
        context.rename(context.makeQualified(new), context.makeQualified(self._at("_current")), how)

    def _forget(self, batch: int) -> None:
        named = sorted(f.getPath().getName() for f in self._system.listStatus(self._folder) if f.getPath().getName().startswith("v-"))
        for name in [n for n in named if int(n[2:]) <= batch][:-KEPT]:
            self._system.delete(self._at(name), True)

    def replace(self, df: DataFrame, batch: int) -> None:
        """Make df the table. Series that it lacks are gone."""
        now = self.batch()
        if now is not None and batch <= now:
            return  # the batch has been taken in
        df.write.mode("overwrite").parquet(self._version(batch))
        self._point(batch)
        self._forget(batch)

    def upsert(self, df: DataFrame, batch: int, keys: list[str], values: list[str], order: list[str]) -> None:
        """Take in rows of df: of each key and column the last value by `order` that isn't null stays, whatever batch it came in.

        The table has a struct for each column, of the order and the value (x); see gauges().
        """
        now = self.batch()
        if now is not None and batch <= now:
            return
        cell = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("x"))).alias(c)
        rows = df.select(*keys, *map(cell, values))
        old = self.read()
        if old is not None:
            rows = rows.unionByName(old)
        self.replace(rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in values)), batch)

    def gauges(self, keys: list[str], values: list[str]) -> DataFrame | None:
        """The keys and current values of a table that upsert() keeps."""
        now = self.read()
        return None if now is None else now.select(*keys, *(F.col(f"{c}.x").alias(c) for c in values))


class LateRows:
    """Rows of a stream that come when their window has been closed, as foreachBatch sees them: kept beside, batch by batch.

    As Spark has it for windowed aggregations: a batch closes the windows whose end is not after its watermark, which is the
    latest event time of the batches before it less a delay, in whole milliseconds; what comes for them in later batches is
    late. So a batch's late rows are those behind the watermark of the batch before.
    """

    def __init__(self, spark: SparkSession, path: str, micros: str, window_us: int, late_us: int):
        self.spark, self.path, self.micros, self.window, self.late = spark, path, micros, window_us, late_us
        self.seen = VersionedTable(spark, f"{path}-seen")

    def watermark(self, batch: int) -> int | None:
        """Of the batch before this one. A batch that runs again finds the times of the batches before it still there."""
        rows = self.seen.read()
        got = [] if rows is None else [r["top"] for r in rows.where(F.col("batch") < batch - 1).select("top").collect() if r["top"] is not None]
        return (max(got) - self.late) // 1_000 * 1_000 if got else None

    def take(self, df: DataFrame, batch: int) -> None:
        mark = self.watermark(batch)
        end: Column = F.floor(F.col(self.micros) / self.window) * self.window + self.window
        late = df.where(end <= mark) if mark is not None else df.where(F.lit(False))
        late.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        top = df.agg(F.lit(batch).cast("long").alias("batch"), F.max(self.micros).alias("top"))
        old = self.seen.read()
        if old is not None:
            # of the batches up to the one before last the latest time is enough: three rows at most
            kept = F.greatest(F.col("batch"), F.lit(batch - 2))
            old = old.where(F.col("batch") < batch).groupBy(kept.alias("batch")).agg(F.max("top").alias("top"))
            top = top.unionByName(old)
        self.seen.replace(top, batch)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
