"""From flags to raw alerts, reduced alerts and alert states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import HeldSince, scan
from ..functions.windows import Series
from .joins import bucket_of, time_buckets

#: What the taxonomy calls each metric, for the mode that means it.
SHORT_NAMES = {"traffic_total": "traffic", "error_rate": "errors", "discard_rate": "discards", "broadcast_total": "broadcast", "multicast_total": "multicast", "unknown_total": "unknown_protocol", "avg_packet_size": "packets"}
#: Kinds of problem, of which the first that fits counts: name, metrics that are there, metrics that aren't, least number of ports. Fixed values.
TAXONOMY = (
    ("Broadcast storm / L2 loop", ("broadcast",), (), 2),
    ("Multicast flooding", ("multicast",), (), 2),
    ("Queue congestion", ("traffic", "discards"), ("errors",), 1),
    ("Queue / buffer pressure", ("discards",), (), 1),
    ("Link quality issue", ("errors",), ("traffic",), 1),
    ("Unknown protocol / scan", ("unknown_protocol",), (), 1),
    ("Traffic or packet surge", ("packets", "traffic"), (), 1),
    ("Packet surge / possible scan", ("packets",), (), 1),
    ("Traffic surge / capacity pressure", ("traffic",), (), 1),
    ("Broadcast anomaly", ("broadcast",), (), 1),
    ("Multicast anomaly", ("multicast",), (), 1),
)
OTHER = "General anomaly"
BUCKET_US = 900_000_000


def raw_alerts(flags: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each flag that is 1: keys, metric, alert_name, bucket (15 minutes)."""
    columns = [c for c in flags.columns if "__flag_" in c]
    long = flags.unpivot(keys, columns, "alert_name", "_flag").where("_flag = 1")
    return long.select(*keys, F.split_part("alert_name", F.lit("__flag_"), F.lit(1)).alias("metric"), "alert_name", (F.floor(F.col("us") / BUCKET_US) * BUCKET_US).alias("bucket"))


def severity(rows: Column, ports: Column, metrics: Column) -> Column:
    return F.least(F.lit(100), 20 + 8 * rows + 15 * ports + 12 * metrics).cast("int")


def problem_type(metrics: Column, ports: Column) -> Column:
    """The first kind of TAXONOMY that an array of metrics and a number of ports fit."""
    all_of = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    fits = [(F.size(F.array_except(all_of(there), metrics)) == 0) & ~F.arrays_overlap(all_of(absent), metrics) & (ports >= least) for _, there, absent, least in TAXONOMY]
    return F.coalesce(*(F.when(fit, kind[0]) for fit, kind in zip(fits, TAXONOMY, strict=True)), F.lit(OTHER))


def reduce_alerts(raw: DataFrame, mode: str = "reference", label: str | None = None) -> DataFrame:
    """Alerts of a bucket as one: by alert name (mode "reference"), or all of them under short metric names ("intended").

    In reference mode a group has one metric, under a name that the taxonomy doesn't know, so that all are general.
    With `label`, the group's distinct values of that column come as event_labels.
    """
    intended = mode == "intended"
    name = F.col("metric")
    if intended:
        name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SHORT_NAMES.items() for x in kv)), name), name)
    keys = ["bucket"] if intended else ["bucket", "alert_name"]
    sets = {"ports": F.col("port").cast("string"), "metrics": F.col("metric")} | ({"labels": F.col(label)} if label else {})
    grouped = raw.withColumn("metric", name).groupBy(*keys).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("raw_alert_count"), *(F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()))
    n_ports, n_metrics = F.size("ports"), F.size("metrics")
    return grouped.select(
        *keys, "start_us", "end_us", problem_type(F.col("metrics"), n_ports).alias("problem_type"), F.array_join("ports", ",").alias("affected_ports"), n_ports.alias("affected_port_count"),
        F.array_join("metrics", ",").alias("evidence_metrics"), "raw_alert_count", severity(F.col("raw_alert_count"), n_ports, n_metrics).alias("severity_score"), *([F.array_join("labels", ",").alias("event_labels")] if label else []),
    )


def merge_by_type(reduced: DataFrame) -> DataFrame:
    """Reduced alerts of one kind of problem and day as one: problem_type, day_us, start, end, events, raw alerts, worst severity."""
    day = 86_400_000_000
    at = (F.floor(F.col("start_us") / day) * day).alias("day_us")
    return reduced.groupBy("problem_type", at).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("events"), F.sum("raw_alert_count").alias("raw_alert_count"), F.max("severity_score").alias("severity_score"))


def suppress(alerts: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Alerts outside all planned intervals (start_us, end_us). Intervals are cut into time buckets, so that rows meet them by an equality."""
    return alerts.join(time_buckets(maintenance), (bucket_of(F.col("us")) == F.col("_bucket")) & alerts["us"].between(F.col("start_us"), F.col("end_us")), "left_anti")


def hourly_volume(raw: DataFrame) -> DataFrame:
    """Alerts of each hour between the first and the last, hours without one included."""
    hour = 3_600_000_000
    counts = raw.groupBy((F.floor(F.col("us") / hour) * hour).alias("hour")).agg(F.count(F.lit(1)).alias("alerts"))
    spine = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(hour))).alias("hour"))
    return spine.join(counts, "hour", "left").fillna(0, ["alerts"])


def alert_states(df: DataFrame, by: str | list[str], flag: Column, hold_seconds: float | Column) -> DataFrame:
    """inactive, pending, firing: a flag must hold for a time; any other value starts it anew."""
    series = Series((by,) if isinstance(by, str) else tuple(by), ("us", "event_id"))
    hold = (hold_seconds if isinstance(hold_seconds, Column) else F.lit(float(hold_seconds))) * F.lit(1_000_000)
    state = F.when(F.col("since_us").isNull(), "inactive").when(F.col("us") - F.col("since_us") >= hold, "firing").otherwise("pending")
    return scan(df, series, {"since_us": HeldSince(flag)}).withColumn("state", state)
