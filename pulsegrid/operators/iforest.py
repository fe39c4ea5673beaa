"""Isolation forest, robust scaling and feature contributions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_or_zero
from ..functions.windows import Series, frame_quantile, own_rows, with_halo, with_row_halo
from .quantiles import quantile_table, with_quantiles

TREES, SAMPLE, CONTAMINATION, SEED = 250, 256, 0.035, 42


def average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 at a leaf), threshold, left, right, and the depth that a leaf stands for."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray

    def path(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.depth[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] < self.threshold[node], self.left[node], self.right[node])


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    nodes: list[list[float]] = []
    work = [(np.arange(len(x)), 0, -1, 0)]
    while work:
        rows, depth, parent, side = work.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if depth >= limit or len(rows) < 2:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(high > low)
        if not len(wide):
            continue
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        nodes[me][0], nodes[me][1] = f, cut
        less = x[rows, f] < cut
        work += [(rows[less], depth + 1, me, 0), (rows[~less], depth + 1, me, 1)]
    a = np.array(nodes)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


def fit(df: DataFrame, features: Column, key: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> tuple[list[Tree], int]:
    """Trees, each of `sample` rows of the whole table, taken by a hash of their key.

    A row is a candidate of as many trees as give each tree four times its sample, one at least; what a tree's hash leaves
    out stays where it is. Trees grow in tasks; only their nodes, `sample` leaves at most, come to the driver.
    """
    rows = df.select(features.alias("x"), F.xxhash64(*key, F.lit(seed)).alias("h")).where("x is not null")
    n = rows.count()
    if not n:
        return [], 0
    each = max(1, min(trees, -(-4 * sample * trees // n)))
    share = min(1.0, 4.0 * sample * trees / (float(n) * each))
    tree = F.pmod(F.col("h") + F.col("j"), F.lit(trees)).cast("int")
    drawn = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).select("x", tree.alias("tree"), F.xxhash64("h", "j").alias("draw"))
    drawn = drawn.where(F.pmod(F.xxhash64("draw"), F.lit(1 << 40)) < F.lit(share * (1 << 40)))
    chosen = drawn.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("draw", "x"))).where(F.col("place") <= sample)

    def plant(own: pd.DataFrame) -> pd.DataFrame:
        own, which = own.sort_values("place"), int(own["tree"].iloc[0])
        t = grow(np.array(own["x"].tolist(), dtype=float), np.random.default_rng([seed, which]))
        return pd.DataFrame({"tree": [which], "rows": [len(own)], **{k: [getattr(t, k)] for k in ("feature", "threshold", "left", "right", "depth")}})

    schema = "tree int, rows int, feature array<long>, threshold array<double>, left array<long>, right array<long>, depth array<double>"
    grown = chosen.groupBy("tree").applyInPandas(plant, schema).orderBy("tree").collect()
    kinds = (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("depth", float))
    return [Tree(*(np.array(r[k], dtype=t) for k, t in kinds)) for r in grown], max(r["rows"] for r in grown)


def window_features(df: DataFrame, s: Series, columns: list[str], seconds: int, rows: int, least: int = 3) -> tuple[DataFrame, list[str]]:
    """mean, std, max, min, P95 and slope (difference to `rows` rows before) of each column over (t - seconds, t]; what is missing is 0."""
    cut, stretch = with_halo(df, s, seconds)
    w, stats, made = stretch.span(seconds), {}, {}
    for c in columns:
        x = F.col(c).cast("double")
        values = {"mean": F.avg(x).over(w), "std": F.stddev_samp(x).over(w), "max": F.max(x).over(w), "min": F.min(x).over(w), "p95": frame_quantile(x, w, 0.95)}
        stats |= {f"{c}_{n}": F.when(F.count(x).over(w) >= least, v) for n, v in values.items()}
    out, series = with_row_halo(own_rows(cut.withColumns(stats)), s, rows + 1)
    made = {f"{c}_slope": F.col(c) - F.lag(c, rows).over(series.window) for c in columns}
    names = [f"{c}_{n}" for c in columns for n in ("mean", "std", "max", "min", "p95", "slope")]
    out = own_rows(out.withColumns(made))
    return out.withColumns({n: finite_or_zero(F.col(n).cast("double")) for n in names}), names


def score(df: DataFrame, features: Column, model: tuple[list[Tree], int]) -> DataFrame:
    """Adds score = 2 ** (-mean path / c(sample size)), by batches; null features give null."""
    trees, size = model
    shared = df.sparkSession.sparkContext.broadcast([(t.feature, t.threshold, t.left, t.right, t.depth) for t in trees])
    scale = float(average_path(size)) or 1.0

    @F.pandas_udf("double")
    def path_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest = [Tree(*t) for t in shared.value]
        for x in batches:
            out = pd.Series(np.nan, index=x.index, dtype="float64")
            ok = x.notna()
            if ok.any() and forest:
                m = np.array(x[ok].tolist(), dtype=float)
                out[ok] = 2.0 ** (-np.mean([t.path(m) for t in forest], axis=0) / scale)
            yield out.astype(object).where(ok, None) if not ok.all() else out

    return df.withColumn("score", path_score(features))


def robust_scale(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(x - median) / IQR with exact quantiles, as <column>_scaled; an IQR of 0 counts as 1."""
    q = quantile_table(df, by, {f"_q{k}_{c}": (c, (0.25, 0.5, 0.75)[k]) for c in columns for k in range(3)})
    out = df.join(q, by) if by else df.crossJoin(F.broadcast(q))  # without `by` this is one row
    scaled = {}
    for c in columns:
        lo, mid, hi = (F.col(f"_q{k}_{c}") for k in range(3))
        scaled[f"{c}_scaled"] = (F.col(c) - mid) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return out.withColumns(scaled).drop(*(f"_q{k}_{c}" for c in columns for k in range(3)))


def label_summary(scored: DataFrame, label: str) -> DataFrame:
    """avg_score, p95_score, anomaly_rate and rows of each label. scored: score, anomaly and a label."""
    summary = scored.groupBy(label).agg(F.avg("score").alias("avg_score"), F.avg(F.col("anomaly").cast("int")).alias("anomaly_rate"), F.count(F.lit(1)).alias("rows"))
    return with_quantiles(summary, scored, [label], {"p95_score": ("score", 0.95)})


def flagged(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Add anomaly: whether the score is above the quantile that leaves a share of `contamination` above it."""
    limit = quantile_table(scored, [], {"_limit": ("score", 1 - contamination)})  # one row
    return scored.crossJoin(F.broadcast(limit)).withColumn("anomaly", F.coalesce(F.col("score") > F.col("_limit"), F.lit(False))).drop("_limit")


def contributions(df: DataFrame, columns: list[str], chosen: Column, top: int = 15) -> DataFrame:
    """feature, contribution: mean of |x - median| / MAD over the chosen rows, medians over all; a MAD of 0 counts as 1.

    Medians and MADs come from selections over all columns at once.
    """
    mid = quantile_table(df, [], {f"_m_{c}": (c, 0.5) for c in columns})
    df = df.crossJoin(F.broadcast(mid))  # one row
    away = df.withColumns({f"_a_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in columns})
    mads = quantile_table(away, [], {f"_d_{c}": (f"_a_{c}", 0.5) for c in columns})
    both = away.where(chosen).crossJoin(F.broadcast(mads))  # one row
    means = both.agg(*(F.avg(F.col(f"_a_{c}") / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(F.lit(1.0))).alias(c) for c in columns))
    return means.unpivot([], columns, "feature", "contribution").orderBy(F.col("contribution").desc(), "feature").limit(top)
