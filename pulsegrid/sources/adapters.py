"""The driver tables in the shapes that the telemetry operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counters of the wide table: name -> (aggregate, event type).
WIDE = {
    "INOCTETS": ("sum", "view"),
    "OUTOCTETS": ("sum", "click"),
    "INUCASTPKTS": ("count", "view"),
    "OUTUCASTPKTS": ("count", "click"),
    "INERRORS": ("count", "error"),
    "INDISCARDS": ("count", "signup"),
    "INBROADCASTPKTS": ("count", "purchase"),
}

EV_SQL = "ev AS (SELECT event_type AS entity, event_id, ts, epoch_us(ts) AS us, value, user_id FROM events)"
WIDE_SQL = (
    "wide AS (SELECT user_id % 5 AS port, date_trunc('hour', ts) AS ts, epoch_us(date_trunc('hour', ts)) AS us, "
    + ", ".join(f"coalesce({'sum(value)' if a == 'sum' else 'count(*)'} FILTER (event_type = '{t}'), 0)::{'DOUBLE' if a == 'sum' else 'BIGINT'} AS {c}" for c, (a, t) in WIDE.items())
    + ", 0::BIGINT AS OUTERRORS, 0::BIGINT AS OUTDISCARDS, 0::BIGINT AS OUTBROADCASTPKTS, 0::BIGINT AS INMULTICASTPKTS, 0::BIGINT AS OUTMULTICASTPKTS, 0::BIGINT AS INUNKNOWNPROTOS FROM events GROUP BY ALL)"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ev_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series for each event type: entity, event_id, ts, us (microseconds), value, user_id."""
    df = read(spark, sf_dir, "events")
    return df.select(F.col("event_type").alias("entity"), "event_id", "ts", micros(F.col("ts")).alias("us"), "value", "user_id")


def ev_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counters of five ports, one row for each port and hour that has events."""
    df = read(spark, sf_dir, "events")
    aggs = []
    for name, (how, kind) in WIDE.items():
        if how == "sum":
            aggs.append(F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)).alias(name))
        else:
            aggs.append(F.count(F.when(F.col("event_type") == kind, 1)).alias(name))
    zero = ("OUTERRORS", "OUTDISCARDS", "OUTBROADCASTPKTS", "INMULTICASTPKTS", "OUTMULTICASTPKTS", "INUNKNOWNPROTOS")
    wide = df.groupBy((F.col("user_id") % 5).alias("port"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(*aggs)
    return wide.withColumns({c: F.lit(0).cast("long") for c in zero}).withColumn("us", F.unix_micros("ts"))
