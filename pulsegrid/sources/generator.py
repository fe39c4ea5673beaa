"""Seeded telemetry for demonstrations and tests: seasonal and weekly traffic, spikes, and injected events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import WILDCARD, bucket_of, time_buckets

PORTS = (("core-1", "7427", "uplink", 9.0e7, 0.55, 820), ("core-1", "7428", "server", 5.5e7, 0.35, 610), ("core-1", "7429", "access", 2.4e7, 0.70, 540), ("edge-1", "7430", "uplink", 7.2e7, 0.60, 760), ("edge-1", "7431", "storage", 6.1e7, 0.45, 980))
STEP_SECONDS = 300


def _noise(seed: int, what: str) -> Column:
    """Uniform in (0, 1), from a hash of port and time: the same on every run and for every partitioning."""
    return (F.pmod(F.xxhash64("port_id", "timestamp", F.lit(f"{seed}/{what}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _hashed(seed: int, what: str, *columns: str) -> Column:
    return (F.pmod(F.xxhash64(*columns, F.lit(f"{seed}/{what}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _poisson(u: Column, mean: float) -> Column:
    """A Poisson draw from a uniform one: by its distribution, or, from a mean of 30 on, rounded from a normal one."""
    if mean >= 30:
        z = 4.91 * (F.pow(u, F.lit(0.14)) - F.pow(1 - u, F.lit(0.14)))  # a close form of the normal quantile
        return F.greatest(F.lit(0.0), F.round(mean + mean**0.5 * z))
    p, total, out = math.exp(-mean), 0.0, F.lit(0.0)
    for k in range(1, int(mean + 12 * mean**0.5 + 12)):
        total += p
        p *= mean / k
        out = out + (u > total).cast("double")
    return out


def _normal(seed: int, what: str) -> Column:
    return F.sqrt(-2 * F.ln(_noise(seed, what + "a"))) * F.cos(2 * F.pi() * _noise(seed, what + "b"))


def telemetry(spark: SparkSession, start: str = "2026-02-01 00:00:00", days: int = 30, seed: int = 42) -> DataFrame:
    """Five ports every five minutes. Counts are those of the interval. Errors and discards are Poisson draws."""
    ports = spark.createDataFrame(PORTS, "device_id string, port_id string, port_role string, base double, in_share double, packet int")
    spine = spark.range(0, days * 86_400 // STEP_SECONDS).select((F.to_timestamp(F.lit(start)) + F.make_dt_interval(secs=F.col("id") * STEP_SECONDS)).alias("timestamp"))
    df = spine.join(F.broadcast(ports))  # five rows
    hour = F.hour("timestamp") + F.minute("timestamp") / 60
    daily = 0.35 + 0.65 * F.exp(-F.pow((hour - 14) / 5, 2))
    weekly = F.when(F.weekday("timestamp") >= 5, 0.6).otherwise(1.0)
    spike = F.when(_noise(seed, "spike") < 0.006, 1.5 + 2 * _noise(seed, "size")).otherwise(1.0)
    traffic = F.col("base") * daily * weekly * spike * F.exp(0.08 * _normal(seed, "level"))
    df = df.withColumn("traffic", traffic).withColumn("INOCTETS", F.round(F.col("traffic") * F.col("in_share"), 2))
    df = df.withColumn("OUTOCTETS", F.round(F.col("traffic") - F.col("INOCTETS"), 2))
    packets = lambda c: F.floor(F.col(c) / F.col("packet"))
    rare = lambda what, mean: _poisson(_noise(seed, what), mean).cast("long")
    df = df.withColumns({"INUCASTPKTS": packets("INOCTETS"), "OUTUCASTPKTS": packets("OUTOCTETS")})
    share = {"INNUCASTPKTS": ("INUCASTPKTS", 0.002), "OUTNUCASTPKTS": ("OUTUCASTPKTS", 0.002), "INBROADCASTPKTS": ("INUCASTPKTS", 0.001), "OUTBROADCASTPKTS": ("OUTUCASTPKTS", 0.001), "INMULTICASTPKTS": ("INUCASTPKTS", 0.0015), "OUTMULTICASTPKTS": ("OUTUCASTPKTS", 0.0015)}
    df = df.withColumns({c: F.floor(F.col(a) * p * (0.8 + 0.4 * _noise(seed, c))) for c, (a, p) in share.items()})
    df = df.withColumns({c: rare(c, p) for c, p in (("INERRORS", 0.015), ("OUTERRORS", 0.010), ("INDISCARDS", 0.04), ("OUTDISCARDS", 0.05), ("INUNKNOWNPROTOS", 0.01))})
    return df.withColumn("event_label", F.lit("normal")).withColumn("event_id", F.lit("")).drop("traffic", "base", "in_share", "packet")


def inject(rows: DataFrame, intervals: DataFrame, value: str, key: str, factor: float) -> DataFrame:
    """Multiply a value inside intervals (MULTI: on every key) by `factor`, ramped from 0.8 to 1 over the interval."""
    marked = _inside(rows, intervals, key)
    ramp = 0.8 + 0.2 * (F.col("us") - F.col("start_us")) / F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1))
    return marked.withColumn("injected", F.when(F.col("label").isNotNull(), F.col(value) * factor * ramp).otherwise(F.col(value)))


def _inside(rows: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Rows with the interval they are in, if any: its id as label, its kind and its ends."""
    cut = time_buckets(intervals.withColumnRenamed("event_id", "label"))
    here = (bucket_of(F.col("us")) == F.col("_bucket")) & F.col("us").between(F.col("start_us"), F.col("end_us"))
    return rows.join(cut, here & ((F.col("port") == F.col(key).cast("string")) | (F.col("port") == WILDCARD)), "left").drop("_bucket")


_BOTH = lambda *names: tuple(f"{way}{name}" for name in names for way in ("IN", "OUT"))
#: What the kinds of events do: counters and factors, counters and what comes on top (mean of a Poisson draw, and a ramp from 0.8 or, from a share of
#: the event on, from 0.5 to 1.2 of a size). Fixed values.
EFFECTS = {
    "business_traffic_growth": ({_BOTH("OCTETS", "UCASTPKTS"): 1.9}, {}),
    "small_packet_scan": ({_BOTH("UCASTPKTS"): 8.0, _BOTH("OCTETS"): 1.25}, {}),
    "large_file_backup": ({_BOTH("OCTETS"): 5.2, _BOTH("UCASTPKTS"): 2.0}, {}),
    "queue_congestion": ({_BOTH("OCTETS", "UCASTPKTS"): 3.8}, {_BOTH("DISCARDS"): (0, 600, 0.0)}),
    "link_quality_issue": ({}, {_BOTH("ERRORS"): (180, 100, 0.0)}),
    "load_sensitive_link_issue": ({_BOTH("OCTETS"): 2.8}, {_BOTH("ERRORS"): (120, 120, 0.35)}),
    "broadcast_storm": ({_BOTH("BROADCASTPKTS", "NUCASTPKTS"): 18.0}, {_BOTH("DISCARDS"): (80, 0, 0.0)}),
    "multicast_flooding": ({_BOTH("MULTICASTPKTS"): 16.0}, {_BOTH("DISCARDS"): (45, 0, 0.0)}),
    "abnormal_device_sender": ({("OUTOCTETS", "OUTUCASTPKTS", "OUTNUCASTPKTS"): 5.5, ("OUTBROADCASTPKTS", "OUTMULTICASTPKTS"): 2.5}, {}),
    "unknown_protocol_scan": ({("INUCASTPKTS",): 2.4}, {("INUNKNOWNPROTOS",): (440, 0, 0.0)}),
}


def inject_kinds(rows: DataFrame, intervals: DataFrame, key: str, seed: int | None = 42) -> DataFrame:
    """Change the counters of rows (key, us) inside intervals (event_id, kind, port, start_us, end_us) as their kinds do in EFFECTS.

    What comes on top is ramped over the interval and drawn by a hash of row and seed; without a seed it is the mean.
    Rows gain event_label (normal) and event_id (empty). Counters that the rows lack are left out; an unknown kind changes
    none. A row in several intervals comes once for each of them.
    """
    out = _inside(rows, intervals, key)
    at = (F.col("us") - F.col("start_us")) / F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1))
    new = {}
    for c in rows.columns:
        x = F.col(c)
        for kind, (factors, more) in EFFECTS.items():
            here = F.col("kind") == kind
            for counters, factor in factors.items():
                if c in counters:
                    x = F.when(here, x * factor).otherwise(x)
            for counters, (mean, size, share) in more.items():
                if c in counters:
                    ramp = 0.8 + 0.2 * at if not share else 0.5 + 0.7 * (at - share) / (1 - share)
                    draw = F.lit(float(mean)) if seed is None or not mean else _poisson(_hashed(seed, c, key, "us"), mean)
                    x = F.when(here & (at >= share), x + draw + F.round(size * ramp)).otherwise(x)
        if x is not None and any(c in cs for f, m in EFFECTS.values() for cs in (*f, *m)):
            new[c] = x
    out = out.withColumns(new)
    out = out.withColumn("event_label", F.coalesce("kind", F.lit("normal"))).withColumn("event_id", F.coalesce("label", F.lit("")))
    return out.select(*rows.columns, *(c for c in ("event_label", "event_id") if c not in rows.columns))
