"""Scalar expressions on columns: guarded ratios, clipping, scaling, text and label helpers. All stay in code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9

#: Interface names that belong to the host itself, not to the network.
LOCAL_DEVICES = ("lo", "docker", "veth", "br-", "vbox")


def safe_div(a: Column, b: Column) -> Column:
    """a / b where b > 0, else 0. Null where a is null and b > 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def eps_div(a: Column, b: Column, eps: float = EPSILON) -> Column:
    """a / (b + eps), for denominators that are never negative."""
    return a / (b + F.lit(eps))


def plus_one_div(a: Column, b: Column) -> Column:
    return a / (b + 1)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; null stays null (greatest and least alone would ignore it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def finite_or_zero(x: Column) -> Column:
    """0 in place of null, NaN and both infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def half_even(x: Column, digits: int) -> Column:
    """Rounding with ties to even."""
    return F.bround(x, digits)


def min_max_scale(df: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """(x - min) / (max - min + 1e-9) over all rows, or those with the same `by`.

    The extremes come from an aggregation that each task starts by itself, and its few rows are joined back, so no window
    gathers the table.
    """
    columns, by = list(columns), list(by)
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    ends = df.groupBy(*by).agg(*aggs)
    out = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # without `by` this is one row
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + EPSILON) for c in columns}
    return out.withColumns(scaled).drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def columns_with(df: DataFrame, part: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if part in c and c.endswith(suffix)]


def is_local_device(name: Column) -> Column:
    out = F.lit(False)
    for prefix in LOCAL_DEVICES:
        out = out | name.startswith(prefix)
    return out


def matches(value: Column, regex: str) -> Column:
    """The whole value fits the expression, as label matchers mean it."""
    return value.rlike(f"^(?:{regex})$")


def relative(x: Column, mean: Column) -> tuple[Column, Column]:
    """x / mean and (x - mean) / mean; null where the mean is 0."""
    safe = F.when(mean != 0, mean)
    return x / safe, (x - mean) / safe


def truncate_text(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def any_keyword(text: Column, keywords: Iterable[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(F.lower(text), F.lit(k.lower()))
    return out


def lookup(key: Column, mapping: dict, default) -> Column:
    """A literal map; keys that it lacks give the default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


