"""Scans over whole series without a task that holds one: running sums, fills, runs of flags and CUSUM with a carry.

A series is cut into stretches of some thousand rows. Each stretch is scanned by itself and summed up in one row (its sum,
its last value, its state if it had begun from nothing). A scan over those rows, which are few, tells what every stretch
takes over from the ones before it (or after it), and a join adds that to its rows. So a series of any length spreads over
as many tasks as it has stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import COUNTED_ROWS, Series, cut_places

Layers = list[dict[str, Column]]


@dataclass(frozen=True)
class Carries:
    """Windows over the stretches of a series, in order."""

    by: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy("_chunk")

    @property
    def past(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def future(self) -> WindowSpec:
        """The stretches after this one, the last of them first (see Series.future)."""
        return Window.partitionBy(*self.by).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)


class Scan:
    """One scanned column. `p` is a prefix that its own helper columns start with.

    local: layers of columns over the rows of a stretch, `{p}l` the scanned value as if the stretch were the whole series.
    summary: aggregates of a stretch. carry: layers over the summaries, of which those named `{p}c...` go back to the rows.
    value: the scanned value of a row.
    """

    def local(self, p: str, s: Series) -> Layers:
        raise TypeError("a scan has its own local()")

    def summary(self, p: str, order: Column) -> dict[str, Column]:
        raise TypeError("a scan has its own summary()")

    def carry(self, p: str, w: Carries) -> Layers:
        raise TypeError("a scan has its own carry()")

    def value(self, p: str) -> Column:
        return F.coalesce(f"{p}l", f"{p}c")


@dataclass(frozen=True)
class RunningSum(Scan):
    """Sum of the values so far, this row's included; null until there is one."""

    x: Column

    def local(self, p, s):
        return [{f"{p}l": F.sum(self.x).over(s.past())}]

    def summary(self, p, order):
        return {f"{p}s": F.sum(self.x)}

    def carry(self, p, w):
        return [{f"{p}c": F.sum(f"{p}s").over(w.past)}]

    def value(self, p):
        return F.coalesce(F.col(f"{p}l") + F.col(f"{p}c"), f"{p}l", f"{p}c")


@dataclass(frozen=True)
class RunningCount(RunningSum):
    """Number of values so far that aren't null; of F.lit(1), the row's number."""

    def local(self, p, s):
        return [{f"{p}l": F.count(self.x).over(s.past())}]

    def summary(self, p, order):
        return {f"{p}s": F.count(self.x)}


@dataclass(frozen=True)
class LastKnown(Scan):
    """The last value so far that isn't null."""

    x: Column

    def local(self, p, s):
        return [{f"{p}l": F.last(self.x, ignorenulls=True).over(s.past())}]

    def summary(self, p, order):
        return {f"{p}s": F.max_by(self.x, F.when(self.x.isNotNull(), order))}

    def carry(self, p, w):
        return [{f"{p}c": F.last(f"{p}s", ignorenulls=True).over(w.past)}]


@dataclass(frozen=True)
class NextKnown(Scan):
    """The first value from this row on that isn't null."""

    x: Column

    def local(self, p, s):
        return [{f"{p}l": F.last(self.x, ignorenulls=True).over(s.future())}]

    def summary(self, p, order):
        return {f"{p}s": F.min_by(self.x, F.when(self.x.isNotNull(), order))}

    def carry(self, p, w):
        return [{f"{p}c": F.last(f"{p}s", ignorenulls=True).over(w.future)}]


@dataclass(frozen=True)
class Before(Scan):
    """The row before's value."""

    x: Column

    def local(self, p, s):
        return [{f"{p}l": F.lag(F.struct(self.x.alias("x"))).over(s.window)}]

    def summary(self, p, order):
        return {f"{p}s": F.max_by(F.struct(self.x.alias("x")), order)}

    def carry(self, p, w):
        return [{f"{p}c": F.lag(f"{p}s").over(w.window)}]

    def value(self, p):
        return F.coalesce(f"{p}l", f"{p}c")["x"]


@dataclass(frozen=True)
class NextTime(Scan):
    """The next later time of the series. Rows of one time are never in two stretches."""

    micros: str = "us"

    def local(self, p, s):
        later = Window.partitionBy(*s.by).orderBy(F.col(self.micros).desc()).rangeBetween(Window.unboundedPreceding, -1)
        return [{f"{p}l": F.min(self.micros).over(later)}]

    def summary(self, p, order):
        return {f"{p}s": F.min(self.micros)}

    def carry(self, p, w):
        return [{f"{p}c": F.min(f"{p}s").over(w.future)}]


@dataclass(frozen=True)
class Cusum(Scan):
    """max(0, S + d) from 0, to within rounding (see cusum); a null leaves S.

    A stretch takes S to max(S + D, E), where D is the sum of its steps and E what it ends with from 0. After several
    stretches that is P + max(0, highest E - P), with P the sum of all D so far.
    """

    d: Column

    def local(self, p, s):
        return [{f"{p}r": F.sum(F.coalesce(self.d, F.lit(0.0))).over(s.past())}, {f"{p}l": F.col(f"{p}r") - F.least(F.lit(0.0), F.min(f"{p}r").over(s.past()))}]

    def summary(self, p, order):
        return {f"{p}d": F.sum(F.coalesce(self.d, F.lit(0.0))), f"{p}e": F.max_by(f"{p}l", order)}

    def carry(self, p, w):
        total = F.sum(f"{p}d").over(w.window.rowsBetween(Window.unboundedPreceding, 0))
        over = F.max(F.col(f"{p}e") - F.col(f"{p}p")).over(w.past)
        return [{f"{p}p": total}, {f"{p}c": F.lag(f"{p}p").over(w.window) + F.greatest(F.lit(0.0), over)}]

    def value(self, p):
        return F.greatest(F.col(f"{p}l"), F.col(f"{p}r") + F.coalesce(f"{p}c", F.lit(0.0)))


class _Runs(Scan):
    """What scans of runs of a flag share: the flag before, within the stretch (none: false)."""

    flag: Column

    @property
    def on(self) -> Column:
        return F.coalesce(self.flag, F.lit(False))

    def rise(self, s: Series) -> Column:
        return self.on & ~F.coalesce(F.lag(self.on).over(s.window), F.lit(False))


@dataclass(frozen=True)
class RunNumber(_Runs):
    """How many runs of set flags have begun so far."""

    flag: Column

    def local(self, p, s):
        return [{f"{p}u": self.rise(s).cast("long")}, {f"{p}l": F.sum(f"{p}u").over(s.past())}]

    def summary(self, p, order):
        return {f"{p}s": F.sum(f"{p}u"), f"{p}first": F.min_by(self.on, order), f"{p}last": F.max_by(self.on, order)}

    def carry(self, p, w):
        # a run that goes on from the stretch before was counted again
        goes_on = (F.col(f"{p}first") & F.coalesce(F.lag(f"{p}last").over(w.window), F.lit(False))).cast("long")
        return [{f"{p}g": goes_on}, {f"{p}c": F.coalesce(F.sum(F.col(f"{p}s") - F.col(f"{p}g")).over(w.past), F.lit(0)) - F.col(f"{p}g")}]

    def value(self, p):
        return F.col(f"{p}l") + F.col(f"{p}c")


@dataclass(frozen=True)
class HeldSince(_Runs):
    """The time at which the flag's present run began; null where it isn't set."""

    flag: Column
    micros: str = "us"

    def local(self, p, s):
        begun = F.when(self.rise(s), F.col(self.micros))
        return [{f"{p}b": begun}, {f"{p}l": F.last(f"{p}b", ignorenulls=True).over(s.past()), f"{p}whole": F.min(self.on).over(s.past())}]

    def summary(self, p, order):
        return {f"{p}last": F.max_by(self.on, order), f"{p}all": F.min(self.on), f"{p}since": F.max_by(f"{p}l", order)}

    def carry(self, p, w):
        # a stretch that is all one run says when it began only if none goes on into it
        runs_in = F.coalesce(F.lag(f"{p}last").over(w.window), F.lit(False))
        known = F.when(F.col(f"{p}last") & ~(F.col(f"{p}all") & F.col(f"{p}in")), F.col(f"{p}since"))
        return [{f"{p}in": runs_in}, {f"{p}k": known}, {f"{p}c": F.when(F.col(f"{p}in"), F.last(f"{p}k", ignorenulls=True).over(w.past))}]

    def value(self, p):
        return F.when(self.on, F.coalesce(F.when(F.col(f"{p}whole"), F.col(f"{p}c")), f"{p}l"))


def _layers(df: DataFrame, made: list[Layers]) -> DataFrame:
    for k in range(max(map(len, made))):
        df = df.withColumns({name: c for layers in made if k < len(layers) for name, c in layers[k].items()})
    return df


def in_stretches(df: DataFrame, s: Series) -> tuple[DataFrame, Series, int]:
    """Each row once, with the stretch that it belongs to (_chunk); and an upper bound of the number of stretches."""
    placed, cuts, n = cut_places(df, s)
    cuts = cuts.select("_cut_key", "_cut_at", F.col("_cut_first").alias("_chunk"))
    out = placed.join(F.broadcast(cuts) if n <= COUNTED_ROWS else cuts, ["_cut_key", "_cut_at"]).drop("_cut_key", "_cut_at")
    return out, Series((*s.by, "_chunk"), s.order, s.micros), n


def scan(df: DataFrame, s: Series, wanted: dict[str, Scan]) -> DataFrame:
    """Add scanned columns. Rows are shuffled and sorted once, by stretch; the summaries are read off the same shuffle."""
    cut, stretch, n = in_stretches(df, s)
    scans = [(f"_{k}_", v) for k, v in enumerate(wanted.values())]
    local = _layers(cut, [v.local(p, stretch) for p, v in scans])
    keys, order = (*s.by, "_chunk"), F.struct(*s.order)
    summaries = local.groupBy(*keys).agg(*(c.alias(name) for p, v in scans for name, c in v.summary(p, order).items()))
    carried = _layers(summaries, [v.carry(p, Carries(s.by)) for p, v in scans])
    back = [c for p, _ in scans for c in carried.columns if c.startswith(f"{p}c")]
    carried = carried.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(keys)), *back)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(keys)]
    together = local.join(F.broadcast(carried) if n <= COUNTED_ROWS else carried, same)
    return together.select(*df.columns, *(v.value(p).alias(name) for name, (p, v) in zip(wanted, scans, strict=True)))


def falls_to_zero(c: float, steps: np.ndarray) -> np.ndarray:
    """max(0, c + step) after each step, added up in turn."""
    return np.fromiter(accumulate(steps.tolist(), lambda c, x: c + x if c + x > 0 else 0.0, initial=c), dtype=np.float64, count=len(steps) + 1)[1:]


def cusum(df: DataFrame, s: Series, d: Column, name: str) -> DataFrame:
    """Add max(0, S + d) from 0, with the very bits of a loop over the series, so that S meets a limit where the loop's does.
    A null leaves S, and minus infinity begins anew.

    A stretch in which S falls to 0 whatever it takes over ends as it does from 0. A new run of stretches begins after each
    of these, and rows are added up in turn within a run alone. Which stretches those are is told from sums, with a margin
    far above their rounding. Steps that never bring S back to 0 make one long run, as no bit of a later S is known before the
    rows between; its rows pass through one task, a batch at a time.
    """
    cut, _, n = in_stretches(df.withColumn("_d", F.coalesce(d.cast("double"), F.lit(0.0))), s)
    keys, order = [*s.by, "_chunk"], [(c, "ascending") for c in s.order]

    def sum_up(table: pa.Table) -> pa.Table:
        x = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start")).column("_d").to_numpy()
        anew, end = np.isneginf(x), falls_to_zero(0.0, x)[-1]
        finite = np.where(anew, 0.0, x)
        sums = np.cumsum(finite)
        made = {"_d": sums[-1], "_e": end, "_low": -np.inf if anew.any() else sums.min(), "_size": np.abs(finite).sum()}
        out = table.slice(0, 1).select(keys)
        for k, v in made.items():
            out = out.append_column(k, pa.array([v], pa.float64()))
        return out

    fields = [T.StructField(k, T.DoubleType()) for k in ("_d", "_e", "_low", "_size")]
    summaries = cut.select(*keys, *(c for c in s.order if c not in keys), "_d").groupBy(*keys).applyInArrow(sum_up, T.StructType([*(cut.schema[k] for k in keys), *fields]))
    w = Carries(s.by)
    upto = w.window.rowsBetween(Window.unboundedPreceding, 0)
    closed = F.coalesce("_c", F.lit(0.0)) + F.col("_low") < -1e-7 * F.sum("_size").over(upto)
    begins = F.when(F.coalesce(F.lag("_closed").over(w.window), F.lit(True)), F.struct(F.col("_chunk").alias("at"), F.coalesce(F.lag("_e").over(w.window), F.lit(0.0)).alias("s")))
    runs = _layers(summaries, [[*Cusum(d).carry("_", w), {"_closed": closed}, {"_begins": begins}, {"_run": F.last("_begins", ignorenulls=True).over(upto)}]])
    runs = runs.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(keys)), F.col("_run.at").alias("_run"), F.col("_run.s").alias("_s"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(keys)]
    rows = cut.join(F.broadcast(runs) if n <= COUNTED_ROWS else runs, same).select(*df.columns, "_d", "_run", "_s")
    rows = rows.repartition(*s.by, "_run").sortWithinPartitions(*s.by, "_run", *s.order)
    kept, run_keys = df.columns, [*s.by, "_run"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, c = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in run_keys]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in codes], axis=0)) + 1
            x, made = batch.column("_d").to_numpy(), np.empty(batch.num_rows)
            for a, b in pairwise([0, *change.tolist(), batch.num_rows]):
                if (here := [batch.column(k)[a].as_py() for k in run_keys]) != own:
                    own, c = here, batch.column("_s")[a].as_py()
                made[a:b] = falls_to_zero(c, x[a:b])
                c = float(made[b - 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(made)], [*kept, name])

    return rows.mapInArrow(add_up, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def counter_rate(df: DataFrame, s: Series, x: str, name: str, default_seconds: float = 300.0) -> DataFrame:
    """Rise of a counter a second: falls give 0, the first row 0. Of equal times the next step that isn't 0 counts."""
    us = F.col(s.micros)
    df = scan(df, s, {"_before": Before(F.struct(F.col(x).alias("x"), us.alias("us"))), "_later": NextTime(s.micros)})
    step = (us - F.col("_before.us")) / 1e6
    # the later steps start from the next later time
    step = F.when(step > 0, step).otherwise((F.col("_later") - us) / 1e6)
    rise = F.greatest(F.coalesce(F.col(x) - F.col("_before.x"), F.lit(0.0)), F.lit(0.0))
    return df.withColumn(name, rise / F.coalesce(step, F.lit(default_seconds))).drop("_before", "_later")


def fill_both(df: DataFrame, s: Series, x: str, name: str) -> DataFrame:
    """The last value so far, or else the first one to come."""
    df = scan(df, s, {"_last": LastKnown(F.col(x)), "_next": NextKnown(F.col(x))})
    return df.withColumn(name, F.coalesce("_last", "_next")).drop("_last", "_next")


def interpolate(df: DataFrame, s: Series, x: str, name: str) -> DataFrame:
    """Linear in time between the values around a gap; the last value after the end, null before the first."""
    us, known = F.col(s.micros), F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(s.micros).alias("us")))
    df = scan(df, s, {"_0": LastKnown(known), "_1": NextKnown(known)})
    x0, x1, t0, t1 = F.col("_0.x"), F.col("_1.x"), F.col("_0.us"), F.col("_1.us")
    between = x0 + (x1 - x0) * ((us - t0) / F.when(t1 > t0, t1 - t0))
    return df.withColumn(name, F.when(F.col(x).isNotNull(), F.col(x)).otherwise(F.coalesce(between, x0))).drop("_0", "_1")


def expanding_mean(df: DataFrame, s: Series, x: str, name: str) -> DataFrame:
    """Mean of the values so far."""
    df = scan(df, s, {"_sum": RunningSum(F.col(x)), "_n": RunningCount(F.col(x))})
    return df.withColumn(name, F.col("_sum") / F.when(F.col("_n") > 0, F.col("_n"))).drop("_sum", "_n")
