"""Rolling statistics over an entity's rows in time order.

A Series names the entity and order columns. A statistic is null until its frame has `least` values; a frame of n rows
includes the current one. NaN must not occur in the data: null stands for what is missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pandas.api.indexers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAD_SCALE = 1.4826


@dataclass(frozen=True)
class Series:
    by: tuple[str, ...] = ("entity",)
    order: tuple[str, ...] = ("ts", "event_id")
    #: Microseconds, for frames in time.
    micros: str = "us"

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def rows(self, n: int, end: int = 0) -> WindowSpec:
        """The n rows up to `end` rows after this one (negative: before)."""
        return self.window.rowsBetween(end - n + 1, end)

    def past(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def future(self) -> WindowSpec:
        """This row and those after it, the last of them first: a window that ends at its row takes it in, while one that begins there is read anew for every row."""
        return Window.partitionBy(*self.by).orderBy(*(F.col(c).desc() for c in self.order)).rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    def span(self, seconds: float) -> WindowSpec:
        """Rows in (t - seconds, t]: open on the left."""
        return Window.partitionBy(*self.by).orderBy(self.micros).rangeBetween(-int(seconds * 1_000_000) + 1, 0)


def with_halo(df: DataFrame, s: Series, seconds: float, chunk_seconds: float | None = None) -> tuple[DataFrame, Series]:
    """Cut a series into stretches of time, so that frames of `seconds` need no task with a whole entity.

    A row goes to its own stretch and to the next ones that can see it. Compute the windows over the Series that comes
    back, then keep the rows with `_own`. Stretches are 16 frames long unless told otherwise, so that one row in 16 is sent twice.
    """
    chunk = int((chunk_seconds or 16 * seconds) * 1_000_000)
    # rows without a time are a stretch of their own
    first = F.coalesce(F.floor(F.col(s.micros) / chunk), F.lit(-(1 << 60)))
    last = F.coalesce(F.floor((F.col(s.micros) + int(seconds * 1_000_000)) / chunk), F.lit(-(1 << 60)))
    out = df.withColumn("_first", first).withColumn("_chunk", F.explode(F.sequence("_first", last)))
    return out.withColumn("_own", F.col("_chunk") == F.col("_first")).drop("_first"), Series((*s.by, "_chunk"), s.order, s.micros)


#: Rows that a stretch of with_row_halo has, and the time that rows are counted by at first (an hour).
STRETCH_ROWS, COUNTED_US = 4_096, 3_600_000_000
#: A table of counts of so many rows goes to every task; rows meet a larger one by a join.
COUNTED_ROWS = 100_000


def cut_places(df: DataFrame, s: Series) -> tuple[DataFrame, DataFrame, int]:
    """Where stretches of STRETCH_ROWS rows begin: the rows with (_cut_key, _cut_at); for each such pair the number of rows before it
    and in it, and the stretch in which it begins (_cut_key, _cut_at, _cut_before, _cut_n, _cut_first); and how many pairs there are.

    Rows are counted by entity and hour (or less, where an hour has more rows than a stretch), so that it is known how many
    lie before each hour. The order has to agree with the time.
    """
    key, width = F.coalesce(F.xxhash64(*s.by), F.lit(0)), COUNTED_US
    while True:
        at = F.coalesce(F.floor(F.col(s.micros) / width), F.lit(-(1 << 60)))
        counts = df.groupBy(key.alias("_cut_key"), at.alias("_cut_at")).agg(F.count(F.lit(1)).alias("_cut_n"))
        size = counts.agg(F.count(F.lit(1)).alias("cuts"), F.max("_cut_n").alias("most")).first()
        if (size["most"] or 0) <= STRETCH_ROWS or width == 1:
            break
        width = max(1, width * STRETCH_ROWS // (2 * size["most"]))
    before = F.coalesce(F.sum("_cut_n").over(Window.partitionBy("_cut_key").orderBy("_cut_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # entities whose keys collide are counted as one, which moves the cuts and no result
    cuts = counts.withColumn("_cut_before", before).withColumn("_cut_first", F.floor(F.col("_cut_before") / STRETCH_ROWS))
    return df.withColumns({"_cut_key": key, "_cut_at": at}), cuts, size["cuts"]


def with_row_halo(df: DataFrame, s: Series, rows: int, ahead: int = 0) -> tuple[DataFrame, Series]:
    """Cut a series into stretches of some thousand rows, so that frames of up to `rows` rows, and of `ahead` rows after the
    current one, need no task with a whole entity.

    A row goes to the stretch in which its hour begins (see cut_places), to those that begin less than `rows` rows after its
    hour, and to those that end less than `ahead` rows before it: two to four copies, however dense the rows. Compute the
    windows over the Series that comes back, then keep the rows with `_own`.
    """
    placed, cuts, n = cut_places(df, s)
    chunk = lambda place: F.floor(place / STRETCH_ROWS)
    after = F.col("_cut_before") + F.col("_cut_n")
    others = [F.sequence(chunk(after), chunk(after + max(0, rows - 2)))]
    if ahead:  # a stretch may have rows of the next one's places, up to its own length
        others.append(F.sequence(F.greatest(chunk(F.col("_cut_before") - ahead) - 1, F.lit(0)), F.col("_cut_first")))
    cuts = cuts.select("_cut_key", "_cut_at", "_cut_first", F.array_union(F.array("_cut_first"), F.array_union(*others) if ahead else others[0]).alias("_cut_all"))
    if n <= COUNTED_ROWS:
        cuts = F.broadcast(cuts)
    out = placed.join(cuts, ["_cut_key", "_cut_at"])
    out = out.withColumn("_chunk", F.explode("_cut_all")).withColumn("_own", F.col("_chunk") == F.col("_cut_first"))
    return out.drop("_cut_key", "_cut_at", "_cut_first", "_cut_all"), Series((*s.by, "_chunk"), s.order, s.micros)


def order_statistics(df: DataFrame, s: Series, columns: dict[str, tuple[str, int, int, str | float]]) -> DataFrame:
    """Medians, MADs and quantiles over the last rows of a table that with_row_halo has cut; only its own rows come back.

    columns: new name -> (column, n, least, what), where what is "mad" or a share such as 0.95. A statistic is of the
    values that aren't null among the last n rows, this one included, and null with fewer than `least` of them. Frames of
    a stretch are sorted in numpy, once for all statistics of a column and n.
    """
    kept = [c for c in df.columns if c not in ("_own", "_chunk")]
    wanted: dict[tuple[str, int], list[tuple[str, int, str | float]]] = {}
    for name, (x, n, least, what) in columns.items():
        wanted.setdefault((x, n), []).append((name, least, what))
    order = [(c, "ascending") for c in s.order]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        out = table.take(pa.array(own)).select(kept)
        for (x, n), stats in wanted.items():
            values = table.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False)
            made = _sorted_frames(np.array(values, dtype=np.float64), own, n, [(least, what) for _, least, what in stats])
            for (name, _, _), column in zip(stats, made, strict=True):
                out = out.append_column(name, pa.array(column, from_pandas=True))
        return out

    fields = [f for f in df.schema.fields if f.name in kept]
    names = [name for stats in wanted.values() for name, _, _ in stats]
    schema = T.StructType([*fields, *(T.StructField(name, T.DoubleType()) for name in names)])
    return df.groupBy(*s.by).applyInArrow(run, schema)


def _sorted_frames(values: np.ndarray, rows: np.ndarray, n: int, stats: list[tuple[int, str | float]]) -> list[np.ndarray]:
    """For each statistic (least, what), its values at these rows; NaN stands for null."""
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), values]), n)
    out = [np.full(len(rows), np.nan) for _ in stats]
    for a in range(0, len(rows), 1024):
        block = np.sort(frames[rows[a : a + 1024]], axis=1)  # NaN goes last
        count = n - np.isnan(block).sum(axis=1)
        for made, (least, what) in zip(out, stats, strict=True):
            if what == "mad":
                away = np.sort(np.abs(block - _quantile(block, count, 0.5)[:, None]), axis=1)
                got = _quantile(away, count, 0.5)
            else:
                got = _quantile(block, count, what)
            made[a : a + 1024] = np.where(count >= max(1, least), got, np.nan)
    return out


def _quantile(ordered: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """Linear interpolation between the two nearest of the first `count` values of each row."""
    at = q * np.maximum(count - 1, 0)
    low = np.take_along_axis(ordered, np.floor(at).astype(np.int64)[:, None], axis=1)[:, 0]
    high = np.take_along_axis(ordered, np.ceil(at).astype(np.int64)[:, None], axis=1)[:, 0]
    return low + (high - low) * (at - np.floor(at))


def roll_order(df: DataFrame, s: Series, columns: dict[str, tuple[str, int, int, str | float]]) -> DataFrame:
    """Add rolling medians, MADs and quantiles to a table; see order_statistics."""
    cut, stretch = with_row_halo(df, s, max(n for _, n, _, _ in columns.values()))
    return order_statistics(cut, stretch, columns)


class Frames:
    """The frames (t - seconds, t] of a stretch's rows, which are in the order of time; rows of one time see each other.

    Rows are cut into blocks as long as a frame, so that a frame is the end of one block and the beginning of the next. What
    is folded from each row to both ends of its block gives every frame by one more step: the work grows with the rows, not
    with the rows of a frame, and no sum is taken away from another.
    """

    def __init__(self, us: np.ndarray, seconds: float) -> None:
        span = int(seconds * 1_000_000)
        block = us // span
        self.us, self.starts = us, np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(us)])
        #: The first row of each frame, and the one after its last.
        self.first, self.end = np.searchsorted(us, us - span, "right"), np.searchsorted(us, us, "right")
        self.crosses = self.first < self.starts[np.searchsorted(self.starts, np.arange(len(us)), "right") - 1]

    def fold(self, x: np.ndarray, step: np.ufunc) -> np.ndarray:
        """np.add, np.fmin or np.fmax over each frame."""
        upto, after = np.empty_like(x), np.empty_like(x)
        for a, b in zip(self.starts, [*self.starts[1:], len(x)], strict=True):
            upto[a:b], after[a:b] = step.accumulate(x[a:b]), step.accumulate(x[a:b][::-1])[::-1]
        return np.where(self.crosses, step(after[self.first], upto[self.end - 1]), upto[self.end - 1])

    def count(self, x: np.ndarray) -> np.ndarray:
        return self.fold((~np.isnan(x)).astype(np.int64), np.add)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of the values that aren't missing, with more digits than a double."""
        return self.fold(np.where(np.isnan(x), 0, x).astype(np.longdouble), np.add)

    def products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows that have both: their number, means of x and y, mean product of the deviations from these. NaN without such rows."""
        both = ~(np.isnan(x) | np.isnan(y))
        # values are taken from the middle of the stretch, so that products keep their digits
        x0, y0 = (np.longdouble(v[both].mean()) if both.any() else np.longdouble(0) for v in (x, y))
        dx, dy = (np.where(both, v - v0, np.longdouble(0)) for v, v0 in ((x, x0), (y, y0)))
        n = self.fold(both.astype(np.int64), np.add)
        some = np.where(n > 0, n, 1).astype(np.longdouble)
        mx, my = self.fold(dx, np.add) / some, self.fold(dy, np.add) / some
        made = (x0 + mx, y0 + my, self.fold(dx * dy, np.add) / some - mx * my)
        return n, *(np.where(n > 0, v, np.nan).astype(np.float64) for v in made)

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and population variance; NaN without values."""
        n, mean, _, variance = self.products(x, x)
        # values that are all alike have none
        same = self.fold(x, np.fmin) == self.fold(x, np.fmax)
        return n, mean, np.where(same, 0.0, np.maximum(variance, 0.0))

    def quantile(self, x: np.ndarray, q: float) -> np.ndarray:
        """Linear interpolation between the two nearest values: a sorted list takes rows in and lets them go."""
        return pd.Series(x).rolling(_Bounds(first=self.first, end=self.end), min_periods=1).quantile(q).to_numpy()


class _Bounds(pd.api.indexers.BaseIndexer):
    """Frames for pandas, which knows no open ends that rows of one time share."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first.astype(np.int64), self.end.astype(np.int64)


def range_frames(df: DataFrame, s: Series, seconds: float, new: str, make: Callable[[Frames, Callable[[str], np.ndarray]], dict[str, np.ndarray]], keep: list[str] | None = None) -> DataFrame:
    """Add columns over frames (t - seconds, t] that numpy makes, one pass over a stretch for all of them.

    make takes the frames and a function that gives a column as doubles (NaN: missing), and gives a value for each row of
    every column in `new`. Only the columns of `keep` come back with these (all, if None).
    """
    cut, stretch = with_halo(df, s, seconds, 4 * seconds)
    kept = df.columns if keep is None else keep
    order = [(c, "ascending") for c in dict.fromkeys((s.micros, *s.order))]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        frames = Frames(table.column(s.micros).fill_null(0).to_numpy(), seconds)
        made = make(frames, lambda c: np.array(table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64))
        out = table.take(pa.array(own)).select(kept)
        for name in made:
            out = out.append_column(name, pa.array(made[name][own], from_pandas=True))
        return out

    schema = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(new).fields])
    return cut.groupBy(*stretch.by).applyInArrow(run, schema)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def enough(x: Column, over: WindowSpec, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(over) >= least, value)


def roll_mean(x: Column, s: Series, n: int, least: int | None = None) -> Column:
    return enough(x, s.rows(n), n if least is None else least, F.avg(x).over(s.rows(n)))


def roll_std(x: Column, s: Series, n: int, least: int | None = None, fill: float = 0.0) -> Column:
    """Sample deviation; `fill` where there isn't enough (one value has none)."""
    w = s.rows(n)
    least = n if least is None else least
    return F.coalesce(F.when(F.count(x).over(w) >= max(2, least), F.stddev_samp(x).over(w)), F.lit(fill))


def frame_values(x: Column, over: WindowSpec) -> Column:
    """The frame's values, sorted. Statistics of one frame share this array; sorting it beats counting values in a map."""
    return F.sort_array(F.collect_list(x).over(over))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def at_quantile(values: Column, q: float) -> Column:
    """Linear interpolation between the two nearest places of a sorted array."""
    at = F.lit(q) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def frame_quantile(x: Column, over: WindowSpec, q: float) -> Column:
    return bind(frame_values(x, over), lambda v: at_quantile(v, q))


def difference(x: Column, s: Series, n: int = 1) -> Column:
    return x - F.lag(x, n).over(s.window)


def shifted_mean(x: Column, s: Series, n: int, least: int) -> Column:
    """Mean of the n rows before this one."""
    w = s.rows(n, -1)
    return enough(x, w, least, F.avg(x).over(w))


def shifted_quantile(x: Column, s: Series, n: int, q: float, least: int) -> Column:
    w = s.rows(n, -1)
    return enough(x, w, least, frame_quantile(x, w, q))


def centred_max(x: Column, s: Series, n: int = 20) -> Column:
    """Largest of n rows, n // 2 of them before this one; null where the frame isn't full."""
    w = s.window.rowsBetween(-(n // 2), n - n // 2 - 1)
    return enough(x, w, n, F.max(x).over(w))


def deadband(flag: Column, s: Series, n: int) -> Column:
    """Whether the last n rows are all flagged; never with fewer than n rows."""
    return F.coalesce(F.sum(flag.cast("int")).over(s.rows(n)) >= n, F.lit(False))


def rising_edge(flag: Column, s: Series) -> Column:
    return F.coalesce(flag, F.lit(False)) & ~F.coalesce(F.lag(flag).over(s.window), F.lit(False))


#: 0.75 ** 130 is below double precision, so this many rows carry an EWMA with alpha 0.25 whole.
EWMA_ROWS = 130


def ewma_rows(alpha: float) -> int:
    """How many rows carry an EWMA whole in double precision."""
    return max(EWMA_ROWS, math.ceil(math.log(6e-17) / math.log(1 - alpha)))


def ewma(x: Column, s: Series, alpha: float = 0.25, rows: int | None = None) -> Column:
    """y0 = x0, y = alpha x + (1 - alpha) y', folded over a frame long enough to be exact in double precision."""
    rows = rows or ewma_rows(alpha)
    values = F.collect_list(x).over(s.rows(rows))
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)), lambda y, v: F.lit(alpha) * v + F.lit(1 - alpha) * y)


def ramp(row: Column, rows: Column, low: float = 0.8, high: float = 1.0) -> Column:
    """From low to high in even steps over the entity's rows."""
    return F.lit(low) + F.lit(high - low) * (row - 1) / F.greatest(rows - 1, F.lit(1))


def slope_ahead(x: Column, s: Series, rows: int = 12, horizon: int = 6) -> Column:
    """An array of `horizon` values ahead, along the line from the frame's first to its last value, never below 0."""
    w = s.rows(rows)
    slope = F.when(F.count(x).over(w) > 1, (F.last(x).over(w) - F.first(x).over(w)) / (F.count(x).over(w) - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(x + slope * h, F.lit(0.0)))
