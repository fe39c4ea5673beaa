"""The live path: replayed telemetry, current gauges, windows, keyed states and alert states, as Structured Streaming.

Each function takes a streaming DataFrame. `drain` runs a stream over what is there and returns the written table; a
service would start the same query with a processing-time trigger.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scans import falls_to_zero
from ..sources.scratch import scratch
from .versions import VersionedTable

#: How late rows may be.
LATE = "1 hour"


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote.

    In append mode Parquet files are added. In other modes, or with `each`, every batch (as `each` makes it) is the whole
    result and takes the last one's place at once (see VersionedTable). The reports of all batches are added to `progress`.
    """
    spark = stream.sparkSession
    out, shape = scratch(spark, "stream"), stream.schema
    table, reports = VersionedTable(spark, out), Reports()
    if progress is not None:
        spark.streams.addListener(reports)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch(spark, "offsets")).outputMode(mode)
    if mode == "append" and each is None:
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, n: table.replace(each(df, n) if each else df, n)).start()
    try:
        query.awaitTermination()
        if (problem := query.exception()) is not None:
            raise problem
        if progress is not None:
            progress += reports.of(query)
    finally:
        if progress is not None:
            spark.streams.removeListener(reports)
    if mode == "append" and each is None:
        return spark.read.schema(shape).parquet(out)
    return done if (done := table.read()) is not None else spark.createDataFrame([], shape)


class Reports(StreamingQueryListener):
    """Every report of every batch: a query itself keeps the last hundred alone."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({"run": str(p.runId), "name": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query: StreamingQuery, seconds: float = 60.0) -> list[dict]:
        """The reports of a query that has ended; they come in some time after it, and its end comes last."""
        self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)
        return [{k: r[k] for k in ("name", "batch", "rows")} for r in self.rows if r["run"] == str(query.runId)]


def replay(spark: SparkSession, df: DataFrame, order: list[str], files: int, per_batch: int = 1, file: Column | None = None) -> DataFrame:
    """A table as a stream in the order of time: cut into files by ranges of `order`, of which each batch takes so many.

    With `file`, a number from 0 below `files`, that says which file a row comes in. What a batch holds, and with it what a keyed state takes in at once, is bounded by the size of these files.
    """
    path = scratch(spark, "replay")
    dealt = df.repartitionByRange(files, *order) if file is None else df.repartitionById(files, file)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # a file source reads by time of change; ranges are numbered in the names
    parts = sorted((f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    for i, part in enumerate(parts):
        system.setTimes(part, 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


#: Rows of a file of a replay, which is what a batch takes at least; and the fewest files, so that a short table takes several batches too.
FILE_ROWS, LEAST_FILES = 1_000_000, 3


def files_for(df: DataFrame) -> int:
    """How many files a replay cuts this table into."""
    return max(LEAST_FILES, -(-df.count() // FILE_ROWS))


def closed_windows(stream: DataFrame, by: str, value: str, width: str) -> DataFrame:
    """Count and sum of each window, told once, when the watermark has passed its end; later rows of it are left out (see LateRows)."""
    return tumbling(stream, by, value, width).drop("mean")


def with_event_time(stream: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Event time as TIMESTAMP (watermarks take no other kind), with a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(stream: DataFrame, by: str, value: str, width: str) -> DataFrame:
    """Count, sum and mean of each window."""
    grouped = stream.groupBy(by, F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return grouped.select(by, F.unix_micros("window.start").alias("start_us"), "n", "total", "mean")


def sliding(stream: DataFrame, by: str, value: str, width: str, step: str) -> DataFrame:
    """Mean and population deviation of overlapping windows."""
    grouped = stream.groupBy(by, F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return grouped.select(by, F.unix_micros("window.start").alias("start_us"), "n", "mean", "std")


def sessions(stream: DataFrame, by: str, gap: str) -> DataFrame:
    """Runs of rows no further apart than the gap."""
    grouped = stream.groupBy(by, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(by, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


def latest(stream: DataFrame, by: str, value: str) -> DataFrame:
    """The current value of each entity; a null keeps the old one."""
    known = F.when(F.col(value).isNotNull(), F.struct("us", "event_id"))
    return stream.groupBy(by).agg(F.max_by(value, known).alias("value"), F.max("us").alias("us"))


def _online(stream: DataFrame, by: str, columns: list[str], new: str, state: str, start: tuple, step: Callable[[pd.DataFrame, tuple], tuple[dict, tuple]]) -> DataFrame:
    """A keyed state that is a few numbers. step takes an entity's rows of a batch, in order, and the state; it gives new columns and the next state.

    Rows have to come in the order of time, batch by batch (see replay).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])  # one entity's rows of one batch, which has a bound
        made, after = step(rows, held.get if held.exists else start)
        held.update(tuple(x.item() if hasattr(x, "item") else x for x in after))
        yield pd.DataFrame({by: key[0], "event_id": rows["event_id"].to_numpy(), **made})

    rows = stream.select(by, "us", "event_id", *columns)
    return rows.groupBy(by).applyInPandasWithState(run, f"{by} string, event_id long, {new}", state, "append", GroupStateTimeout.NoTimeout)


def online_cusum(stream: DataFrame, by: str, center: float, limit: float, missing: float = 0.0) -> DataFrame:
    """One-sided CUSUM with the running sum as state, added up in turn as a loop does. A missing value is a step of `missing`: 0 leaves the sum, minus infinity begins anew."""

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict, tuple]:
        x = rows["value"].to_numpy(dtype=float) - center
        s = falls_to_zero(state[0], np.where(np.isnan(x), missing, x))
        return {"cusum": s, "beyond": s > limit}, (s[-1],)

    return _online(stream, by, ["value"], "cusum double, beyond boolean", "s double", (0.0,), step)


def online_ewma(stream: DataFrame, by: str, limit: float, held: int, alpha: float = 0.25) -> DataFrame:
    """EWMA (y0 = x0), whether it is above a limit, and whether it has been for `held` rows. The state is the mean and the run of rows above."""

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict, tuple]:
        mean, run = state
        x = rows["value"].to_numpy(dtype=float)
        y = pd.Series(x if run < 0 else np.concatenate([[mean], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(x) :]
        above, at = y > limit, np.arange(len(x))
        # rows since the last one that isn't above; before the first such row the run of the batch before goes on
        last = np.maximum.accumulate(np.where(above, -1, at))
        runs = np.where(above, np.where(last < 0, at + 1 + max(run, 0), at - last), 0)
        return {"ewma": y, "above": above, "held": runs >= held}, (y[-1], runs[-1])

    return _online(stream, by, ["value"], "ewma double, above boolean, held boolean", "mean double, run long", (0.0, -1), step)


def online_alerts(stream: DataFrame, by: str, flag: Column, hold_seconds: float) -> DataFrame:
    """inactive, pending, firing: the state is the time since which the flag has held (-1: it doesn't)."""
    hold = int(hold_seconds * 1e6)

    def step(rows: pd.DataFrame, state: tuple) -> tuple[dict, tuple]:
        us, on, at = rows["us"].to_numpy(), rows["flag"].to_numpy(dtype=bool), np.arange(len(rows))
        begins = on & ~np.concatenate([[state[0] >= 0], on[:-1]])
        start = np.maximum.accumulate(np.where(begins, at, -1))
        since = np.where(on, np.where(start < 0, state[0], us[np.maximum(start, 0)]), -1)
        return {"state": np.where(since < 0, "inactive", np.where(us - since >= hold, "firing", "pending"))}, (since[-1],)

    return _online(stream.withColumn("flag", F.coalesce(flag, F.lit(False))), by, ["flag"], "state string", "since long", (-1,), step)


def simulated_time(start_us: Column, elapsed_seconds: Column, speed: float, span_us: Column) -> Column:
    """The replay's clock: start + elapsed * speed, wrapped at the end, in whole seconds."""
    at = F.floor(elapsed_seconds * speed) * 1_000_000
    return start_us + F.pmod(at, span_us + 1_000_000)


def event_marker(current: DataFrame, labels: list[str], by: str, label: str) -> DataFrame:
    """1 for the current label of each entity and 0 for all others."""
    every = F.explode(F.array(*map(F.lit, labels)))
    return current.withColumn("marker", every).select(by, F.col("marker").alias(label), (F.col("marker") == F.col(label)).cast("int").alias("value"))


def health(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """job, up (0 or 1), batches and rows of each query, from the reports that drain() gathers: up once it has ended a batch."""
    rows = [(p["name"], p["batch"], p["rows"]) for p in progress]
    df = spark.createDataFrame(rows, "job string, batch long, rows long")
    return df.groupBy("job").agg((F.count("batch") > 0).cast("int").alias("up"), F.count("batch").alias("batches"), F.sum("rows").alias("rows"))
