"""The query forms of the live path, as builders over narrow samples (metric, labels MAP, us, value).

There is no text language here: selectors, ranges and aggregations are functions from DataFrame to DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import matches
from ..functions.scans import Before, scan
from ..functions.windows import Frames, Series, own_rows, range_frames, with_halo
from ..sources.scratch import written

SECOND = 1_000_000


def select(samples: DataFrame, metric: str, *matchers: tuple[str, str, str]) -> DataFrame:
    """Samples of a metric whose labels fit; matchers are (label, =, !=, =~ or !~, value). A missing label is empty."""
    out = samples.where(F.col("metric") == metric)
    for label, op, value in matchers:
        have = F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit(""))
        fits = {"=": have == value, "!=": have != value, "=~": matches(have, value), "!~": ~matches(have, value)}
        if op not in fits:
            raise ValueError(f"{op!r} is no label matcher")
        out = out.where(fits[op])
    return out


def series_key() -> Column:
    """Labels as one string, alike whatever their order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def instant(samples: DataFrame, at_us: int, lookback_seconds: int = 300) -> DataFrame:
    """The last sample of each series in (at - lookback, at]."""
    kept = samples.where((F.col("us") <= at_us) & (F.col("us") > at_us - lookback_seconds * SECOND))
    return kept.groupBy("metric", series_key().alias("series")).agg(F.max_by("value", "us").alias("value"), F.max("us").alias("us"))


def keyed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series", series_key())


#: Samples of one series, in order.
SAMPLES = Series(("metric", "series"), ("us", "event_id"))


def rate(samples: DataFrame, seconds: int, keep: list[str] | None = None) -> DataFrame:
    """Rise of a counter a second over (t - seconds, t], falls taken as resets, by the time between its first and last sample; null where no step is known.

    Only the columns of `keep` come back with the rate (all, if None).
    """

    def make(frames: Frames, column: Callable[[str], np.ndarray]) -> dict[str, np.ndarray]:
        value = column("value")
        step = np.diff(value, prepend=np.nan)
        up = np.where(step < 0, value, step)
        # the rise into the frame's first sample lies outside; a stretch's own first sample may have none, which is the same
        rise = frames.total(up) - np.nan_to_num(up[frames.first])
        took = (frames.us - frames.us[frames.first]) / SECOND
        return {"rate": np.where((took > 0) & (frames.count(up) > 0), rise / np.where(took > 0, took, 1), np.nan).astype(np.float64)}

    return range_frames(keyed(samples), SAMPLES, seconds, "rate double", make, keep)


def rate_at(samples: DataFrame, seconds: int, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """rate() as the server computes it, at each step of [start, end]: metric, series, us, rate; no row with fewer than two samples.

    The rise between the first and the last sample of (t - seconds, t], with what was lost at resets, is carried on to both
    ends of the range where the samples come near enough (within 1.1 of their mean distance), else by half that distance;
    at the lower end never beyond the time at which the counter was 0. Each sample goes to the steps that see it, seconds /
    step of them, and is summed up there before anything is shuffled, so that no series needs a task of its own.
    """
    span = seconds * SECOND
    before = scan(keyed(samples), SAMPLES, {"_before": Before(F.struct("value", "us"))})
    # the first step at or after the sample, and the last that sees it
    first = F.greatest(F.ceil((F.col("us") - start_us) / step_us), F.lit(0))
    last = F.floor((F.least(F.col("us") + span - 1, F.lit(end_us)) - start_us) / step_us)
    seen = before.withColumn("_first", first).withColumn("_last", last).where("_first <= _last and value is not null")
    seen = seen.withColumn("_step", F.explode(F.sequence("_first", "_last"))).withColumn("_t", F.col("_step") * step_us + start_us)
    lost = F.when((F.col("_before.us") > F.col("_t") - span) & (F.col("value") < F.col("_before.value")), F.col("_before.value"))
    order = F.struct("us", "event_id")
    got = seen.groupBy("metric", "series", F.col("_t").alias("us")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("us").alias("_a"), F.max("us").alias("_b"), F.min_by("value", order).alias("_x"), F.max_by("value", order).alias("_y"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("_lost")
    )
    sampled, rise = (F.col("_b") - F.col("_a")) / SECOND, F.col("_y") - F.col("_x") + F.col("_lost")
    mean = sampled / (F.col("_n") - 1)
    ends = lambda gap: F.when(gap >= 1.1 * mean, mean / 2).otherwise(gap)
    to_start = ends((F.col("_a") - (F.col("us") - span)) / SECOND)
    to_zero = F.when((rise > 0) & (F.col("_x") >= 0), sampled * (F.col("_x") / rise)).otherwise(to_start)
    whole = sampled + F.least(to_start, to_zero) + ends((F.col("us") - F.col("_b")) / SECOND)
    return got.where("_n > 1 and _b > _a").select("metric", "series", "us", (rise * (whole / sampled) / seconds).alias("rate"))


#: Arithmetic between two vectors.
OPERATORS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.when(b != 0, b)}


def match_vectors(left: DataFrame, op: str, right: DataFrame, on: list[str] | None = None, ignoring: list[str] = (), many: str | None = None, include: list[str] = ()) -> DataFrame:
    """left op right where their label sets agree at the same time: labels, us, value.

    Both are vectors (labels MAP without the metric's name, us, value). The label sets that have to agree are those named in
    `on`, or all but those in `ignoring`. Each set may be there once on either side; with many="left" (or "right") that side
    may have several rows for one of the other, keeps its own labels and gets those of `include` from the other side.
    Otherwise more than one is an error. Rows without a partner give none, and a quotient by 0 is null.
    """
    if op not in OPERATORS or many not in (None, "left", "right"):
        raise ValueError(f"{op!r} with many={many!r} is no vector operation")
    chosen = lambda k: k.isin(*on) if on is not None else ~k.isin(*ignoring) if ignoring else F.lit(True)

    def side(df: DataFrame, p: str) -> DataFrame:
        matched = F.map_filter("labels", lambda k, v: chosen(k))
        key = F.array_join(F.transform(F.array_sort(F.map_entries(matched)), lambda e: F.to_json(e)), ",")
        return df.select(key.alias(f"{p}key"), F.col("us").alias(f"{p}us"), F.col("labels").alias(f"{p}labels"), F.col("value").alias(f"{p}value"))

    def once(df: DataFrame, p: str) -> DataFrame:
        rows = df.groupBy(f"{p}key", f"{p}us").agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(f"{p}labels", f"{p}value")).alias("_row"))
        told = F.raise_error(F.concat(F.lit("several series match the label set "), F.col(f"{p}key")))
        value = F.when(F.col("_n") > 1, told.cast("double")).otherwise(F.col(f"_row.{p}value"))
        return rows.select(f"{p}key", f"{p}us", F.col(f"_row.{p}labels").alias(f"{p}labels"), value.alias(f"{p}value"))

    a, b = side(left, "_l"), side(right, "_r")
    a, b = (a if many == "left" else once(a, "_l")), (b if many == "right" else once(b, "_r"))
    both = a.join(b, (F.col("_lkey") == F.col("_rkey")) & (F.col("_lus") == F.col("_rus")))
    own, other = ("_r", "_l") if many == "right" else ("_l", "_r")
    labels = F.col(f"{own}labels")
    if many is None:
        labels = F.map_filter(labels, lambda k, v: chosen(k))
    elif include:
        labels = F.map_concat(F.map_filter(labels, lambda k, v: ~k.isin(*include)), F.map_filter(f"{other}labels", lambda k, v: k.isin(*include)))
    return both.select(labels.alias("labels"), F.col("_lus").alias("us"), OPERATORS[op](F.col("_lvalue"), F.col("_rvalue")).alias("value"))


def over_time(samples: DataFrame, seconds: int, keep: list[str] | None = None) -> DataFrame:
    """avg_over_time, stddev_over_time (population) and count_over_time of each sample's range. Only the columns of `keep` come back with these (all, if None)."""

    def make(frames: Frames, column: Callable[[str], np.ndarray]) -> dict[str, np.ndarray]:
        n, mean, variance = frames.moments(column("value"))
        return {"avg_over_time": mean, "stddev_over_time": np.sqrt(variance), "count_over_time": n}

    return range_frames(keyed(samples), SAMPLES, seconds, "avg_over_time double, stddev_over_time double, count_over_time long", make, keep)


def predict_linear(samples: DataFrame, seconds: int, ahead: int, least_variance: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Least-squares value `ahead` seconds from now, over (t - seconds, t]; null unless the variance of its times (in square seconds) is above the least. With count_over_time, the number of samples.

    Only the columns of `keep` come back with these (all, if None). Times whose variance is below 1e-6 square seconds give few digits.
    """

    def make(frames: Frames, column: Callable[[str], np.ndarray]) -> dict[str, np.ndarray]:
        x, value = column("us") - frames.us[len(frames.us) // 2], column("value")  # whole microseconds
        _, at, spread = frames.moments(x)
        n, _, mean, together = frames.products(x, value)
        slope = together / np.where(spread > least_variance * SECOND**2, spread, np.nan)
        return {"predicted": np.where(n > 0, mean + slope * (x - at + ahead * SECOND), np.nan), "count_over_time": frames.end - frames.first}

    return range_frames(keyed(samples), SAMPLES, seconds, "predicted double, count_over_time long", make, keep)


def aggregate_by(samples: DataFrame, labels: list[str], *, step_us: int) -> DataFrame:
    """sum, avg, max, min, count by labels at each step; a series counts with its last sample of the step."""
    at = (F.floor(F.col("us") / step_us) * step_us).alias("step")
    own = [F.try_element_at("labels", F.lit(x)).alias(x) for x in labels]
    last = keyed(samples).groupBy("metric", "series", at, *own).agg(F.max_by("value", "us").alias("value"))
    return last.groupBy("step", *labels).agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("value").alias("count"))


def reduce_range(samples: DataFrame, keys: list[str], step_us: int) -> DataFrame:
    """last, mean, max, min and count of the samples of each step: the reducers of a panel. Of equal times the largest event_id is last."""
    at = (F.floor(F.col("us") / step_us) * step_us).alias("step")
    last = F.max_by("value", F.struct("us", "event_id")).alias("last")
    return samples.groupBy(*keys, at).agg(last, F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("value").alias("count"))


def topk(df: DataFrame, k: int, by: str, value: str, tie: str) -> DataFrame:
    """The k largest at each step; ranks beyond k are dropped before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def label_values(samples: DataFrame, metric: str, label: str) -> DataFrame:
    return samples.where(F.col("metric") == metric).select(F.try_element_at("labels", F.lit(label)).alias(label)).where(F.col(label).isNotNull()).distinct()


def clamp_min(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


#: Recording rules over the wide table: name -> expression, in the order of their layers. Fixed values.
RECORDING_RULES = {
    "traffic_total": "INOCTETS + OUTOCTETS",
    "errors_total": "INERRORS + OUTERRORS",
    "discards_total": "INDISCARDS + OUTDISCARDS",
    "ucast_total": "INUCASTPKTS + OUTUCASTPKTS",
    "error_rate": "errors_total / greatest(ucast_total, 1)",
    "discard_rate": "discards_total / greatest(ucast_total, 1)",
    "broadcast_total": "INBROADCASTPKTS + OUTBROADCASTPKTS",
}
#: Rules over the last hour of a recorded series: prefix of their names -> series, least deviation that a z-score divides by. Fixed values.
HOURLY_RULES = {"traffic": ("traffic_total", 1.0), "error_rate": ("error_rate", 0.0001), "discard_rate": ("discard_rate", 0.0001), "broadcast": ("broadcast_total", 1.0)}
#: Alert rules: name -> (condition, seconds it has to hold, severity, kind of anomaly). Fixed values.
ALERT_RULES = {
    "TrafficSurge": ("traffic_zscore > 3", 60, "warning", "traffic_surge"),
    "TrafficDrop": ("traffic_zscore < -3", 120, "warning", "traffic_drop"),
    "ErrorRateSurge": ("error_rate_zscore > 3", 60, "critical", "error_burst"),
    "DiscardRateSurge": ("discard_rate_zscore > 3", 60, "warning", "discard_spike"),
    "BroadcastStorm": ("broadcast_zscore > 3", 30, "critical", "broadcast_storm"),
}
RULE_SECONDS = 3600


def record(wide: DataFrame, seconds: int = RULE_SECONDS) -> DataFrame:
    """All recording rules: totals and rates, and over (t - seconds, t] the mean, deviation (population) and z-score of four of them.

    z-scores are rounded to nine digits, so that a threshold is met or not whatever the order of the sums.
    """
    out = wide
    for name, expression in RECORDING_RULES.items():
        out = out.withColumn(name, F.expr(expression))
    out, series = with_halo(out, Series(("port",), ("us",)), seconds)
    w, new = series.span(seconds), {}
    for name, (x, least) in HOURLY_RULES.items():
        mean, std = F.avg(x).over(w), F.stddev_pop(x).over(w)
        new |= {f"{name}_mean_1h": mean, f"{name}_stddev_1h": std, f"{name}_zscore": F.round((F.col(x) - mean) / clamp_min(std, least), 9)}
    return own_rows(out.withColumns(new))


def rule_alerts(recorded: DataFrame, name: str | None = None) -> DataFrame:
    """The state of every alert rule (or of those whose name fits a whole regex) at every row: alert, severity, anomaly_type, port, us, state, since_us."""
    from .alerts import alert_states

    chosen = {n: r for n, r in ALERT_RULES.items() if name is None or re.fullmatch(name, n)}
    fits = [F.struct(F.lit(n).alias("alert"), F.lit(kind).alias("anomaly_type"), F.lit(grade).alias("severity"), F.lit(hold).alias("hold"), F.expr(condition).alias("on")) for n, (condition, hold, grade, kind) in chosen.items()]
    if not fits:
        fits = [F.struct(F.lit("").alias("alert"), F.lit("").alias("anomaly_type"), F.lit("").alias("severity"), F.lit(0).alias("hold"), F.lit(None).cast("boolean").alias("on"))]
    long = recorded.select("port", "us", F.inline(F.array(*fits))).where("alert != ''").withColumn("event_id", F.lit(0))
    long = written(long, "judged")  # it is counted before it is scanned
    states = alert_states(long, ["alert", "port"], F.col("on"), F.col("hold"))
    return states.select("alert", "severity", "anomaly_type", "port", "us", "state", "since_us")


def rule_catalog(spark) -> DataFrame:
    """name, type (recording or alerting), expression, hold_seconds."""
    hourly = [(f"{n}_{kind}", e) for n, (x, least) in HOURLY_RULES.items() for kind, e in (("mean_1h", f"avg_over_time({x}[1h])"), ("stddev_1h", f"stddev_over_time({x}[1h])"), ("zscore", f"({x} - {n}_mean_1h) / clamp_min({n}_stddev_1h, {least})"))]
    rows = [(n, "recording", e, None) for n, e in (*RECORDING_RULES.items(), *hourly)] + [(n, "alerting", r[0], r[1]) for n, r in ALERT_RULES.items()]
    return spark.createDataFrame(rows, "name string, type string, expression string, hold_seconds int")
