"""Data quality, shape, correlation, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import RunningCount, scan
from ..functions.windows import Series, own_rows, with_row_halo
from .quantiles import quantile_table, with_quantiles


def quality_report(df: DataFrame, s: Series, x: str) -> DataFrame:
    """Per entity: rows, nulls, duplicate times, negatives, zeros, gaps unlike the usual step, rows expected at that step."""
    cut, stretch = with_row_halo(df, s, 2)
    marked = own_rows(cut.withColumn("_step", F.col(s.micros) - F.lag(s.micros).over(stretch.window)))
    usual = quantile_table(marked, list(s.by), {"_usual": ("_step", 0.5)})
    return (
        marked.join(usual, list(s.by), "left")
        .groupBy(*s.by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(F.col(x).isNull(), 1)).alias("nulls"),
            F.count(F.when(F.col("_step") == 0, 1)).alias("duplicate_times"),
            F.count(F.when(F.col(x) < 0, 1)).alias("negatives"),
            F.count(F.when(F.col(x) == 0, 1)).alias("zeros"),
            F.count(F.when(F.col("_step") != F.col("_usual"), 1)).alias("irregular"),
            F.floor((F.max(s.micros) - F.min(s.micros)) / F.max("_usual") + 1).alias("expected"),
        )
    )


def shape(df: DataFrame, x: str, by: str) -> DataFrame:
    """Moments and quantiles: skewness and excess kurtosis in population form."""
    moments = df.groupBy(by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), (F.stddev_samp(x) / F.avg(x)).alias("cv")
    )
    out = with_quantiles(moments, df, [by], {"q1": (x, 0.25), "median": (x, 0.5), "q3": (x, 0.75)})
    return out.select(by, "n", "mean", "std", "min", "max", "q1", "median", "q3", "skew", "kurtosis", "cv")


def autocorrelation(df: DataFrame, s: Series, x: str, most: int = 60) -> DataFrame:
    """lag, r of each entity for lags 0 to `most`, or a third of its rows. Each row meets the rows before it in its frame; sums of those pairs are shuffled alone."""
    cut, stretch = with_row_halo(df, s, most + 1)
    frame = F.collect_list(F.struct(F.col(x).alias("v"))).over(stretch.rows(most + 1))
    rows = own_rows(cut.withColumn("_frame", frame)).select(*s.by, F.col(x).alias("_x"), F.posexplode(F.reverse("_frame")).alias("lag", "_before"))
    r = rows.groupBy(*s.by, "lag").agg(F.corr("_x", "_before.v").alias("r"), F.count("_x").alias("_n"))
    n = F.max(F.when(F.col("lag") == 0, F.col("_n"))).over(Window.partitionBy(*s.by))
    r = r.withColumn("n", n).where(F.col("lag") <= F.floor(F.col("n") / 3))
    return r.select(*s.by, "n", "lag", F.when(F.col("lag") == 0, 1.0).otherwise(F.col("r")).alias("r"), (1.96 / F.sqrt("n")).alias("band"))


def segment_multipliers(df: DataFrame, s: Series, metrics: dict[str, float], segments: dict[str, tuple[int, int]], baseline: tuple[int, int]) -> DataFrame:
    """How many times its baseline each metric's mean is within labelled ranges of an entity's rows: by, segment, metric, rows, mean, multiplier.

    Ranges are of rows in order, from the first to before the last, as [first, last). metrics: name -> what is added to the
    baseline's mean before it divides. All metrics and ranges take one aggregation; a range without rows, and a metric
    without a baseline (null, or 0 in all), have a null multiplier.
    """
    at = F.col("_row") - 1
    ranges = {"": baseline, **segments}
    named = F.array_compact(F.array(*(F.when((at >= a) & (at < b), F.lit(name)) for name, (a, b) in ranges.items())))
    rows = scan(df, s, {"_row": RunningCount(F.lit(1))}).withColumn("segment", F.explode(named))
    means = rows.groupBy(*s.by, "segment").agg(F.count(F.lit(1)).alias("rows"), *(F.avg(m).alias(m) for m in metrics))
    long = means.unpivot([*s.by, "segment", "rows"], list(metrics), "metric", "mean")
    plus = F.coalesce(*(F.when(F.col("metric") == m, F.lit(float(x))) for m, x in metrics.items()))
    base = long.where("segment = ''").select(*(F.col(c).alias(f"_by_{c}") for c in s.by), F.col("metric").alias("_metric"), (F.col("mean") + plus).alias("_base"))
    same = F.col("metric") == F.col("_metric")
    for c in s.by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = long.where("segment != ''").join(base, same, "left")
    return out.select(*s.by, "segment", "metric", "rows", "mean", (F.col("mean") / F.when(F.col("_base") != 0, F.col("_base"))).alias("multiplier"))


def resample_mean(df: DataFrame, s: Series, x: str, minutes: int) -> DataFrame:
    """Mean of each bucket, empty buckets between an entity's first and last included (rows 0, mean null)."""
    width = minutes * 60_000_000
    start = F.floor(F.col(s.micros) / width) * width
    sums = df.groupBy(*s.by, start.alias("bucket")).agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("rows"))
    ends = sums.groupBy(*s.by).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    spine = ends.select(*s.by, F.explode(F.sequence("_a", "_b", F.lit(width))).alias("bucket"))
    return spine.join(sums, [*s.by, "bucket"], "left").fillna(0, ["rows"])


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 to bins), n: every bin is there; values outside go to the first or last."""
    at = F.least(F.greatest(F.floor((F.col(x) - low) / ((high - low) / bins)) + 1, F.lit(1)), F.lit(bins)).cast("int")
    counts = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["n"])


def ladder(x: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first limit that x is above."""
    out = None
    for limit, label in steps:
        out = F.when(x > limit, label) if out is None else out.when(x > limit, label)
    return out.otherwise(otherwise)


def diagnosis(summary: DataFrame) -> DataFrame:
    """Verdicts over a table of shape(): how skewed, how variable."""
    return summary.withColumns({"skew_verdict": ladder(F.abs("skew"), (1.5, "strong"), (0.5, "moderate"), otherwise="symmetric"), "cv_verdict": ladder(F.col("cv"), (0.4, "volatile"), (0.15, "moderate"), otherwise="steady")})


#: Verdicts over summary numbers: name -> limits, each with the label of what is above it, and the label below all. Fixed values.
VERDICTS = {
    "acf_verdict": (((0.7, "strong"), (0.4, "moderate")), "weak"),
    "lag_verdict": (((0.7, "strong"), (0.35, "moderate")), "weak"),
    "correlation_verdict": (((0.97, "redundant"),), "distinct"),
    "warm_up_verdict": (((0.3, "too long"),), "fine"),
    "alert_share_verdict": (((0.12, "too many"), (0.005, "fine")), "too few"),
    "alerts_per_hour_verdict": (((5.0, "too many"), (0.1, "fine")), "too few"),
    "threshold_verdict": (((1.5, "high"), (0.8, "fine")), "low"),
    "deadband_verdict": (((0.9, "too strict"), (0.1, "fine")), "no effect"),
    "divergence_verdict": (((1.5, "change"),), "none"),
}


def verdicts(summary: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """Add the verdicts of VERDICTS whose number the table has: verdict name -> column."""
    return summary.withColumns({name: ladder(F.col(c), *VERDICTS[name][0], otherwise=VERDICTS[name][1]) for name, c in numbers.items()})


def window_suggestion(acf: DataFrame, by: str) -> DataFrame:
    """The longest lag whose correlation is outside the band, and four times that lag."""
    out = acf.where("lag > 0 and abs(r) > band").groupBy(by).agg(F.max("lag").alias("longest"))
    return out.withColumn("longest_times_4", 4 * F.col("longest"))
