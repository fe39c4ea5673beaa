"""Interval and as-of joins, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import LastKnown, scan
from ..functions.windows import Series

WILDCARD = "MULTI"
#: Intervals are cut into pieces of a day at most, which rows meet by an equality.
BUCKET_US = 86_400_000_000


def bucket_of(us: Column, bucket_us: int = BUCKET_US) -> Column:
    return F.floor(us / bucket_us)


def time_buckets(intervals: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Each interval (start_us, end_us) once for every time bucket that it touches, as _bucket. One that ends before it starts is left out."""
    pieces = F.sequence(bucket_of(F.col("start_us"), bucket_us), bucket_of(F.col("end_us"), bucket_us))
    return intervals.where("start_us <= end_us").withColumn("_bucket", F.explode(pieces))


def interval_join(rows: DataFrame, intervals: DataFrame, key: str, wildcard: bool = False, bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows (key, us, ...) in closed intervals (event_id, port, start_us, end_us): each pair once.

    With `wildcard`, intervals of port MULTI hold for every key; without, they match no row. Rows meet intervals by time
    bucket and key, those of MULTI by time bucket alone. Spark broadcasts the intervals where their size allows it.
    """
    cut, at = time_buckets(intervals, bucket_us), rows.withColumn("_b", bucket_of(F.col("us"), bucket_us))
    inside = (F.col("_b") == F.col("_bucket")) & F.col("us").between(F.col("start_us"), F.col("end_us"))
    own = at.join(cut.where(F.col("port") != WILDCARD), inside & (F.col("port") == F.col(key).cast("string")))
    if wildcard:
        own = own.unionByName(at.join(cut.where(F.col("port") == WILDCARD), inside))
    return own.drop("_b", "_bucket")


def recall_by_event(joined: DataFrame, intervals: DataFrame, flag: Column) -> DataFrame:
    """rows, hits and recall (0 without rows) of each interval."""
    got = joined.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(flag.cast("long")).alias("hits"))
    out = intervals.select("event_id", "port").join(got, "event_id", "left").fillna(0, ["rows", "hits"])
    return out.withColumn("recall", F.when(F.col("rows") > 0, F.col("hits") / F.col("rows")).otherwise(F.lit(0.0)))


def latest_at(df: DataFrame, us: int | Column, by: str) -> DataFrame:
    """The last row of each entity at or before a time; entities without one are left out. A partial aggregation, no sort."""
    rest = [c for c in df.columns if c != by]
    kept = df.where(F.col("us") <= us)
    return kept.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("us", "event_id")).alias("_row")).select(by, "_row.*")


def ties_at(df: DataFrame, us: int) -> DataFrame:
    """All rows at the latest time at or before this one."""
    kept = df.where(F.col("us") <= us)
    top = kept.agg(F.max("us").alias("_top"))  # one row
    return kept.join(F.broadcast(top), F.col("us") == F.col("_top")).drop("_top")


def as_of(left: DataFrame, right: DataFrame, by: str, value: str) -> DataFrame:
    """For each left row (by, us) the value of the last right row at or before it that has one; none: no row.

    Both sides are lined up in stretches of time and rows, each of which takes over the last value known before it, so that
    one long entity spreads over many tasks; at equal times right rows come first. Of right rows of one time the one with
    the largest value counts.
    """
    a = left.select(*left.columns, F.lit(None).cast("double").alias("_value"), F.lit(1).alias("_side"))
    columns = [F.col(c) if c in (by, "us") else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in left.columns]
    b = right.select(*columns, F.col(value).cast("double").alias("_value"), F.lit(0).alias("_side"))
    out = scan(a.unionByName(b), Series((by,), ("us", "_side", "_value")), {"matched": LastKnown(F.col("_value"))})
    return out.where("_side = 1 and matched is not null").drop("_value", "_side")


def before_and_during(rows: DataFrame, intervals: DataFrame, key: str, value: str, before_us: int) -> DataFrame:
    """Statistics of the time before each interval and inside it: baseline mean, event mean and max, z against the baseline."""
    wide = intervals.withColumn("_start", F.col("start_us")).withColumn("start_us", F.col("start_us") - before_us)
    joined = interval_join(rows, wide, key).withColumn("start_us", F.col("_start"))
    pre, during = F.when(F.col("us") < F.col("start_us"), F.col(value)), F.when(F.col("us") >= F.col("start_us"), F.col(value))
    out = joined.groupBy("event_id").agg(F.avg(pre).alias("baseline_mean"), F.coalesce(F.stddev_samp(pre), F.lit(0.0)).alias("_std"), F.avg(during).alias("event_mean"), F.max(during).alias("event_max"))
    return out.withColumn("z_score", (F.col("event_mean") - F.col("baseline_mean")) / F.greatest("_std", F.lit(1e-6))).drop("_std")


def majority_label(joined: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label; of equally frequent ones the smallest."""
    counts = joined.groupBy(by, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label))
