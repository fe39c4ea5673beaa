"""Exact quantiles by distributed selection.

A quantile lies between the values of two ranks. Passes over the rows narrow each wanted rank to a bin: the bins of an
interval are counted, with the least and largest value of each, and the bin that holds the rank is the next interval. Once
an interval has few rows (or one value), a last pass sorts those alone. So no task and no aggregation buffer ever holds the
values of a group; counts are combined before they are shuffled, and all columns and groups share the same passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Bins of an interval, and rows of one that are sorted in place of being counted again.
BINS, SMALL = 4_096, 10_000
#: So many intervals, of fewer bytes than a hundred each, are kept on the driver between passes and go to every task; a table
#: of more of them is written, and rows meet it by a join.
KEPT_ROWS = 100_000


def _met(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None = None) -> DataFrame:
    """Rows of both that agree on the keys (null equals null); the right side's keys go."""
    right = right.withColumnsRenamed({c: f"_r{k}" for k, c in enumerate(keys)})
    on = F.lit(True)
    for k, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{k}"))
    return left.join(right, on if more is None else on & more).drop(*(f"_r{k}" for k in range(len(keys))))


def _kept(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table between two passes, and whether it was short enough to stay on the driver."""
    rows = df.limit(KEPT_ROWS + 1).toArrow()
    if rows.num_rows <= KEPT_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return written(df, "quantiles"), False


def _ranks(n: Column, shares: Column) -> Column:
    at = F.transform(shares, lambda q: q * (n - 1))
    return F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))


def quantile_table(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """One row for each `by`: its columns and, under each name of `wanted` (column, share), that quantile of the column.

    Linear interpolation between the two nearest ranks of the values that aren't null; null where there is none. Without
    `by` it is one row. NaN must not occur in the data. Groups whose keys are null count as groups.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    shares = {c: [q for x, q in wanted.values() if x == c] for c in columns}
    by = list(by)
    name = {c: f"_v{k}" for k, c in enumerate(columns)}
    values = df.select(*by, *(F.col(c).cast("double").alias(v) for c, v in name.items()))
    ends = values.groupBy(*by).agg(*(f(v).alias(f"{v}_{what}") for v in name.values() for what, f in (("n", F.count), ("lo", F.min), ("hi", F.max))))
    ends, _ = _kept(ends)
    each = [F.struct(F.lit(v).alias("_c"), *(F.col(f"{v}_{what}").alias(f"_{what}") for what in ("n", "lo", "hi")), F.array(*map(F.lit, shares[c])).cast("array<double>").alias("_q")) for c, v in name.items()]
    groups = ends.select(*by, F.inline(F.array(*each)))
    goals = groups.where("_n > 0").select(*by, "_c", F.explode(_ranks(F.col("_n"), F.col("_q"))).alias("_rank"), "_lo", "_hi", "_n").withColumn("_left", F.col("_rank"))
    long = values.select(*by, F.inline(F.array(*(F.struct(F.lit(v).alias("_c"), F.col(v).alias("_x")) for v in name.values())))).where("_x is not null")
    keys = [*by, "_c"]
    goals, short = _kept(goals)
    while True:
        wide = goals.where((F.col("_n") > small) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        goals, short = _kept(goals.where((F.col("_n") <= small) | (F.col("_lo") == F.col("_hi"))).unionByName(_narrowed(long, wide, keys, bins, short)))
    found = goals.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value"))
    rest = goals.where("_lo < _hi")
    if not rest.isEmpty():
        found = found.unionByName(_sorted(long, rest, keys, short))
    # as many values to a group as there are ranks
    known = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_m"))
    n, m = F.col("_n"), F.col("_m")

    def at(q: Column) -> Column:
        place = q * (n - 1)
        low, high = F.try_element_at(m, F.floor(place)), F.try_element_at(m, F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    # a column's quantiles in one array, and a group's columns in one map; without values there is no entry, so that all are null
    got = _met(groups, known, keys).select(*keys, F.transform("_q", at).alias("_at"))
    maps = got.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_at"))).alias("_all"))
    seen = dict.fromkeys(columns, 0)
    pick = []
    for new, (c, _) in wanted.items():
        pick.append(F.get(F.try_element_at("_all", F.lit(name[c])), F.lit(seen[c])).alias(new))
        seen[c] += 1
    out = maps.select(*by, *pick)
    if not by:
        return out
    # groups of nulls alone
    every = ends.select(*by)
    missing = every.join(out.withColumnsRenamed({c: f"_r{k}" for k, c in enumerate(by)}), on=[F.col(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(by)], how="left")
    return missing.select(*by, *wanted)


def _intervals(goals: DataFrame, keys: list[str], short: bool) -> DataFrame:
    out = goals.select(*keys, "_lo", "_hi").distinct()
    return F.broadcast(out) if short else out


def _narrowed(long: DataFrame, goals: DataFrame, keys: list[str], bins: int, short: bool) -> DataFrame:
    """The goals with the bin that holds their rank as the new interval. An interval's ends are never in one bin, so that it shrinks."""
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    inside = _met(long, _intervals(goals, keys, short), keys, x.between(lo, hi))
    # halves, so that no difference of finite values runs over
    share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    place = F.when(x == lo, 0).when(x == hi, bins - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(share * bins), F.lit(1)))))
    counts = inside.groupBy(*keys, "_lo", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_k"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumnRenamed("_lo", "_of")
    left = F.col("_left")
    met = _met(goals, counts, keys, (F.col("_lo") == F.col("_of")) & (left >= F.col("_before")) & (left < F.col("_before") + F.col("_k")))
    return met.select(*keys, "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_k").alias("_n"), (left - F.col("_before")).alias("_left"))


def _sorted(long: DataFrame, goals: DataFrame, keys: list[str], short: bool) -> DataFrame:
    """The values of goals whose intervals have few rows: equal values are counted, what differs is sorted."""
    inside = _met(long, _intervals(goals, keys, short), keys, F.col("_x").between(F.col("_lo"), F.col("_hi")))
    counts = inside.groupBy(*keys, "_lo", "_x").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys, "_lo").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumnRenamed("_lo", "_of")
    left = F.col("_left")
    met = _met(goals, counts, keys, (F.col("_lo") == F.col("_of")) & (left >= F.col("_before")) & (left < F.col("_before") + F.col("_k")))
    return met.select(*keys, "_rank", F.col("_x").alias("_value"))


def with_quantiles(summary: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A table of one row for each `by` (one row without) with quantiles of `df` added."""
    found = quantile_table(df, by, wanted)
    if not by:
        return summary.crossJoin(F.broadcast(found))  # one row each
    return _met(summary, found, list(by))
