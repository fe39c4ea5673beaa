"""Detectors. Each adds its columns to a table of one row for each entity and time; flags are never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPSILON
from ..functions.scans import RunningCount, RunNumber, cusum, scan
from ..functions.windows import MAD_SCALE, Series, deadband, ewma, ewma_rows, own_rows, rising_edge, roll_mean, roll_order, roll_std, with_row_halo
from ..sources.scratch import written
from .quantiles import quantile_table, with_quantiles

#: Which way each metric of the multi-port chain may be out of line.
DIRECTIONS = {"traffic_total": "both", "error_rate": "high", "discard_rate": "high", "broadcast_total": "high", "avg_packet_size": "both"}


def yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def z_score(x: Column, mean: Column, std: Column, floor: float = EPSILON) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def rolling_z(df: DataFrame, s: Series, x: str, n: int = 20, least: int = 3, threshold: float = 3.0, fill: float = 1.0) -> DataFrame:
    """z over the last n rows, this one included, with a missing deviation taken as `fill`; flagged on both sides."""
    cut, s = with_row_halo(df, s, n)
    mean, std = roll_mean(F.col(x), s, n, least), roll_std(F.col(x), s, n, least, fill)
    z = (F.col(x) - mean) / (std + EPSILON)
    return own_rows(cut.withColumn("z", z)).withColumn("z_flag", yes(F.abs("z") > threshold))


def one_sided_z(df: DataFrame, s: Series, x: str, n: int = 20, threshold: float = 3.0, held: int = 3) -> DataFrame:
    """z over n rows that must all be there, flagged on the upper side alone, and the flag held for `held` rows."""
    cut, s = with_row_halo(df, s, n + held - 1)
    mean, std = roll_mean(F.col(x), s, n), F.when(F.count(x).over(s.rows(n)) >= n, F.stddev_samp(x).over(s.rows(n)))
    cut = cut.withColumn("z", (F.col(x) - mean) / (std + EPSILON)).withColumn("z_raw", yes(F.col("z") > threshold))
    return own_rows(cut.withColumn("z_held", deadband(F.col("z_raw"), s, held)))


def robust_z(df: DataFrame, s: Series, x: str, n: int = 288, least: int = 72, threshold: float = 4.0) -> DataFrame:
    """(x - median) / (1.4826 MAD), and whether x is above the frame's P95. A MAD of 0 makes any higher value an anomaly, as the definition has it."""
    df = roll_order(df, s, {"_median": (x, n, least, 0.5), "_mad": (x, n, least, "mad"), "p95": (x, n, least, 0.95)})
    df = df.withColumn("robust_z", (F.col(x) - F.col("_median")) / (MAD_SCALE * F.greatest(F.col("_mad"), F.lit(EPSILON)))).drop("_median", "_mad")
    flags = {"rz_high": F.col("robust_z") > threshold, "rz_low": F.col("robust_z") < -threshold, "p95_flag": F.col(x) > F.col("p95")}
    return df.withColumns({name: yes(c) for name, c in flags.items()})


def direction_flags(features: DataFrame, directions: dict[str, str] = DIRECTIONS) -> DataFrame:
    """19 flags (0 or 1) over a feature table: z and robust z on the sides a metric has, P95 on its upper side."""
    flags = {}
    for m, way in directions.items():
        x = F.col(m)
        z = z_score(x, F.col(f"{m}__mean_1h"), F.col(f"{m}__std_1h"))
        rz = (x - F.col(f"{m}__median_1d")) / (MAD_SCALE * F.greatest(F.col(f"{m}__mad_1d"), F.lit(EPSILON)))
        sides = []
        if way in ("high", "both"):
            sides += [("z_high", z > 3), ("rz_high", rz > 4), ("p95", x > F.col(f"{m}__p95_1d"))]
        if way in ("low", "both"):
            sides += [("z_low", z < -3), ("rz_low", rz < -4)]
        flags |= {f"{m}__flag_{name}": yes(c).cast("int") for name, c in sides}
    return features.withColumns(flags)


def baseline_stats(df: DataFrame, s: Series, x: list[str], rows: int, normal: Column | None = None) -> DataFrame:
    """Mean and sample deviation of each entity's first `rows` (normal) rows, one row for each entity."""
    first = df if normal is None else df.where(normal)
    first = first.withColumn("_rn", F.row_number().over(s.window)).where(F.col("_rn") <= rows)
    return first.groupBy(*s.by).agg(*(f(c).alias(f"{c}_{n}") for c in x for n, f in (("mu", F.avg), ("sigma", F.stddev_samp))))


def spc_charts(df: DataFrame, s: Series, x: str, baseline: DataFrame, lam: float = 0.25) -> DataFrame:
    """Shewhart, EWMA and CUSUM on one metric, all against the baseline's mean and deviation, on the upper side alone.

    The lower Shewhart limit is 0 at least. EWMA's limit is the asymptotic one; CUSUM has k = 0.5 and h = 5 deviations.
    """
    joined = df.join(baseline, list(s.by))
    mu, sigma = F.col(f"{x}_mu"), F.coalesce(F.col(f"{x}_sigma"), F.lit(0.0))
    floor = F.greatest(sigma, F.lit(1e-12))
    cut, stretch = with_row_halo(joined, s, ewma_rows(lam))
    smooth = written(own_rows(cut.withColumn("ewma", ewma(F.col(x), stretch, lam))), "smooth")
    out = cusum(smooth, s, F.col(x) - mu - 0.5 * floor, "cusum")
    out = out.withColumns({"ucl": mu + 3 * sigma, "lcl": F.greatest(mu - 3 * sigma, F.lit(0.0)), "ewma_ucl": mu + 3 * sigma * (lam / (2 - lam)) ** 0.5, "cusum_h": 5 * floor})
    flags = {"shewhart": F.col(x) > F.col("ucl"), "ewma_flag": F.col("ewma") > F.col("ewma_ucl"), "cusum_flag": F.col("cusum") > F.col("cusum_h")}
    out = out.withColumns({k: yes(v) for k, v in flags.items()})
    return out.withColumn("any_spc", F.col("shewhart") | F.col("ewma_flag") | F.col("cusum_flag"))


def western_electric(df: DataFrame, s: Series, x: Column, mu: Column, sigma: Column) -> DataFrame:
    """Four rules: beyond 3 deviations; 9 in a row on one side; 6 steps one way; 2 of 3 beyond 2 deviations on one side."""
    df, s = with_row_halo(df, s, 9)
    up, step = (x > mu).cast("int"), x - F.lag(x).over(s.window)
    down = (x < mu).cast("int")
    df = df.withColumns({"_up": up, "_down": down, "_rise": (step > 0).cast("int"), "_fall": (step < 0).cast("int"), "_hi2": (x > mu + 2 * sigma).cast("int"), "_lo2": (x < mu - 2 * sigma).cast("int")})
    held = lambda c, n, k=None: F.coalesce(F.sum(c).over(s.rows(n)) >= (k or n), F.lit(False))
    out = df.withColumns({"rule1": yes(F.abs(x - mu) > 3 * sigma), "rule2": held("_up", 9) | held("_down", 9), "rule3": held("_rise", 6) | held("_fall", 6), "rule4": held("_hi2", 3, 2) | held("_lo2", 3, 2)})
    return own_rows(out.drop("_up", "_down", "_rise", "_fall", "_hi2", "_lo2"))


def ma_divergence(df: DataFrame, s: Series, x: str, short: int = 6, long: int = 30, least: tuple[int, int] = (3, 15), threshold: float = 0.30) -> DataFrame:
    """Change points: the short mean is off the long one by more than a share of it."""
    cut, s = with_row_halo(df, s, max(short, long))
    cut = cut.withColumns({"ma_short": roll_mean(F.col(x), s, short, least[0]), "ma_long": roll_mean(F.col(x), s, long, least[1])})
    df = own_rows(cut).withColumn("divergence", F.abs(F.col("ma_short") - F.col("ma_long")) / (F.abs("ma_long") + EPSILON))
    return df.withColumn("change_flag", yes(F.col("divergence") > threshold))


def onsets(df: DataFrame, s: Series, x: str, threshold: float = 3.0) -> DataFrame:
    """The first row of each run of z flags and of each run of change points: by, event_id, us, type, z, severity (high beyond 5 deviations)."""
    z = rolling_z(df, s, x, threshold=threshold)
    z = _first_of_runs(z, s, F.col("z_flag"))
    z = z.select(*s.by, "event_id", s.micros, F.lit("zscore").alias("type"), "z", F.when(F.abs("z") > 5, "high").otherwise("medium").alias("severity"))
    c = ma_divergence(df, s, x)
    c = _first_of_runs(c, s, F.col("change_flag"))
    return z.unionByName(c.select(*s.by, "event_id", s.micros, F.lit("changepoint").alias("type"), F.lit(0.0).alias("z"), F.lit("medium").alias("severity")))


def _first_of_runs(df: DataFrame, s: Series, flag: Column) -> DataFrame:
    cut, stretch = with_row_halo(df, s, 2)
    return own_rows(cut.withColumn("_on", rising_edge(flag, stretch))).where("_on")


def threshold_from_start(df: DataFrame, s: Series, x: str, share: float = 0.2, least: int = 10, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Fixed limits for each entity from its first rows (a share of all, `least` at least); out on either side is flagged."""
    counted = scan(df, s, {"_rn": RunningCount(F.lit(1))}).join(df.groupBy(*s.by).agg(F.count(F.lit(1)).alias("_n")), list(s.by))
    start = counted.where(F.col("_rn") <= F.greatest(F.floor(F.col("_n") * share), F.lit(least)))
    limits = quantile_table(start, list(s.by), {"limit_low": (x, low), "limit_high": (x, high)})
    out = df.join(limits, list(s.by))
    return out.withColumn("threshold_flag", yes((F.col(x) > F.col("limit_high")) | (F.col(x) < F.col("limit_low"))))


def outlier_limits(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """IQR and three-deviation limits, one row for each `by` (one row without)."""
    sd = df.groupBy(*by).agg((F.avg(x) - 3 * F.stddev_samp(x)).alias("sd_low"), (F.avg(x) + 3 * F.stddev_samp(x)).alias("sd_high"))
    out = with_quantiles(sd, df, list(by), {"_q1": (x, 0.25), "_q3": (x, 0.75)})
    q1, q3 = F.col("_q1"), F.col("_q3")
    return out.select(*by, (q1 - 1.5 * (q3 - q1)).alias("iqr_low"), (q3 + 1.5 * (q3 - q1)).alias("iqr_high"), "sd_low", "sd_high")


def cap_extremes(df: DataFrame, x: str, by: tuple[str, ...]) -> DataFrame:
    """Values above both upper limits are set to that of three deviations and marked."""
    out = df.join(outlier_limits(df, x, by), list(by))
    flag = yes((F.col(x) > F.col("iqr_high")) & (F.col(x) > F.col("sd_high")))
    return out.withColumn("outlier", flag).withColumn("capped", F.when(flag, F.col("sd_high")).otherwise(F.col(x)))


def deadband_sweep(df: DataFrame, s: Series, flag: Column, widths=(1, 2, 3, 5, 8)) -> DataFrame:
    """The flag held for each of these numbers of rows, in one pass over one window order."""
    cut, s = with_row_halo(df, s, max(widths))
    return own_rows(cut.withColumns({f"held_{n}": deadband(flag, s, n) for n in widths}))


def runs(df: DataFrame, s: Series, flag: Column) -> DataFrame:
    """Runs of flagged rows: by, run, start_us, end_us, rows, seconds."""
    out = scan(df, s, {"run": RunNumber(flag)}).where(yes(flag))
    out = out.groupBy(*s.by, "run").agg(F.min(s.micros).alias("start_us"), F.max(s.micros).alias("end_us"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("seconds", (F.col("end_us") - F.col("start_us")) / 1e6)


def combined(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | yes(f)
    return out


