"""Interval and as-of joins."""

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import detect, joins
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide
from .base import query, r6
from .detector_queries import Z_SQL

S = W.Series()
#: A catalog over the events' month: id, kind, port (an event type or MULTI), start and end in microseconds since 1970, both inside.
HOUR = 3_600_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01
CATALOG = [
    ("A", "traffic_surge", "click", T0 + 50 * HOUR, T0 + 80 * HOUR),
    ("B", "traffic_drop", "view", T0 + 100 * HOUR, T0 + 110 * HOUR),
    ("C", "traffic_surge", "purchase", T0 + 200 * HOUR, T0 + 236 * HOUR),
    ("D", "discard_spike", "error", T0 + 300 * HOUR, T0 + 314 * HOUR),
    ("E", "error_burst", "signup", T0 + 400 * HOUR, T0 + 408 * HOUR),
    ("G", "broadcast_storm", "MULTI", T0 + 500 * HOUR, T0 + 512 * HOUR),
    ("H", "multicast_flooding", "MULTI", T0 + 600 * HOUR, T0 + 618 * HOUR),
]
CAT_SQL = "cat(event, kind, port, start_us, end_us) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {x}, {y})" for a, b, c, x, y in CATALOG) + ")"


#: Which port's telemetry the catalog's port names stand for.
_PORTS = {"click": "0", "view": "1", "purchase": "2", "error": "3", "signup": "4"}
LABELLED_SQL = (
    f"{WIDE_SQL}, lab AS (SELECT wide.port, wide.us, coalesce(min(kind), 'normal') AS event_type FROM wide LEFT JOIN (SELECT CASE port WHEN 'click' THEN '0' WHEN 'view' THEN '1' WHEN 'purchase' THEN '2' WHEN 'error' THEN '3' WHEN 'signup' THEN '4' ELSE port END AS p, kind, start_us, end_us FROM cat) x "
    "ON (x.p = wide.port::VARCHAR OR x.p = 'MULTI') AND wide.us BETWEEN x.start_us AND x.end_us GROUP BY wide.port, wide.us)"
)


def labelled_telemetry(spark, d):
    """port, us and event_type: the catalog's kind of each hourly row (of several the smallest), or normal."""
    rows = ev_wide(spark, d).select(F.col("port").alias("row_port"), "us")
    own = catalog(spark).replace(_PORTS, subset=["port"])
    found = joins.interval_join(rows, own, "row_port", wildcard=True).groupBy("row_port", "us").agg(F.min("kind").alias("kind"))
    return rows.join(found, ["row_port", "us"], "left").select(F.col("row_port").alias("port"), "us", F.coalesce("kind", F.lit("normal")).alias("event_type"))


def catalog(spark):
    return spark.createDataFrame(CATALOG, "event_id string, kind string, port string, start_us long, end_us long")


def _rows(spark, d):
    return ev_series(spark, d).withColumnRenamed("event_id", "row_id")


@query(f"WITH {EV_SQL}, {CAT_SQL} SELECT event, kind, event_id AS row_id, round(value, 2) AS value FROM ev JOIN cat ON entity = port AND us BETWEEN start_us AND end_us")
def interval_join(spark, d):
    df = joins.interval_join(_rows(spark, d), catalog(spark), "entity")
    return df.select(F.col("event_id").alias("event"), "kind", "row_id", F.round("value", 2).alias("value"))


@query(f"WITH {EV_SQL}, {CAT_SQL} SELECT event, entity, count(*) AS n FROM ev JOIN cat ON (entity = port OR port = 'MULTI') AND us BETWEEN start_us AND end_us GROUP BY ALL")
def interval_multi(spark, d):
    df = joins.interval_join(_rows(spark, d), catalog(spark), "entity", wildcard=True)
    return df.groupBy(F.col("event_id").alias("event"), "entity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV_SQL}, {CAT_SQL}, {Z_SQL}, j AS (SELECT event, count(*) AS n, sum(f::INT)::BIGINT AS hits FROM zf JOIN cat ON entity = port AND us BETWEEN start_us AND end_us GROUP BY 1) SELECT cat.event, port, coalesce(n, 0) AS rows, coalesce(hits, 0) AS hits, round(CASE WHEN n > 0 THEN hits / n ELSE 0 END, 3) AS recall FROM cat LEFT JOIN j USING (event)")
def interval_recall(spark, d):
    df = detect.rolling_z(ev_series(spark, d), S, "value", threshold=2.0).withColumnRenamed("event_id", "row_id")
    cat = catalog(spark)
    out = joins.recall_by_event(joins.interval_join(df, cat, "entity"), cat, F.col("z_flag"))
    return out.select(F.col("event_id").alias("event"), "port", "rows", "hits", F.round("recall", 3).alias("recall"))


AT = T0 + 333 * HOUR


@query(f"WITH {EV_SQL} SELECT entity, arg_max(event_id, (us, event_id)) AS event_id, max(us) AS us FROM ev WHERE us <= {AT} GROUP BY entity".replace("(us, event_id))", "row(us, event_id))"))
def asof_latest(spark, d):
    return joins.latest_at(ev_series(spark, d), AT, "entity").select("entity", "event_id", "us")


@query(f"WITH {EV_SQL}, h AS (SELECT entity, us - us % {HOUR} AS us, event_id FROM ev) SELECT entity, event_id, us FROM h WHERE us = (SELECT max(us) FROM h WHERE us <= {AT})")
def asof_ties(spark, d):
    hourly = ev_series(spark, d).select("entity", "event_id", (F.col("us") - F.col("us") % HOUR).alias("us"))
    return joins.ties_at(hourly, AT)


@query(f"WITH {EV_SQL}, l AS (SELECT entity, t AS us FROM (SELECT DISTINCT entity FROM ev), (SELECT unnest(range({T0}, {T0} + 30 * 24 * {HOUR}, 6 * {HOUR})) AS t)) SELECT l.entity, l.us, ev.value AS matched FROM l ASOF JOIN ev ON l.entity = ev.entity AND l.us >= ev.us")
def asof_join(spark, d):
    ev = ev_series(spark, d)
    times = spark.range(T0, T0 + 30 * 24 * HOUR, 6 * HOUR).select(F.col("id").alias("us"))
    # a clock of fixed length for each of the few entities
    left = ev.select("entity").distinct().join(F.broadcast(times)).select("entity", "us")
    return joins.as_of(left, ev, "entity", "value")


@query(
    f"""WITH {EV_SQL}, {CAT_SQL}, j AS (SELECT event, value, us < start_us AS pre FROM ev JOIN cat ON entity = port AND us BETWEEN start_us - 12 * {HOUR} AND end_us)
    SELECT event, round(avg(value) FILTER (pre), 4) AS baseline_mean, round(avg(value) FILTER (NOT pre), 4) AS event_mean, max(value) FILTER (NOT pre) AS event_max,
    round((avg(value) FILTER (NOT pre) - avg(value) FILTER (pre)) / greatest(coalesce(stddev_samp(value) FILTER (pre), 0), 1e-6), 4) AS z_score FROM j GROUP BY event"""
)
def event_context_stats(spark, d):
    df = joins.before_and_during(_rows(spark, d), catalog(spark), "entity", "value", 12 * HOUR)
    return df.select(F.col("event_id").alias("event"), r6(F.col("baseline_mean"), 4).alias("baseline_mean"), r6(F.col("event_mean"), 4).alias("event_mean"), "event_max", r6(F.col("z_score"), 4).alias("z_score"))


@query(f"WITH {EV_SQL}, {CAT_SQL}, m AS (SELECT event, user_id % 5 AS label, count(*) AS n FROM ev JOIN cat ON (entity = port OR port = 'MULTI') AND us BETWEEN start_us AND end_us GROUP BY ALL) SELECT event, arg_min(label, row(-n, label)) AS label FROM m GROUP BY event")
def majority_in_window(spark, d):
    df = joins.interval_join(_rows(spark, d).withColumn("label", F.col("user_id") % 5), catalog(spark), "entity", wildcard=True)
    return joins.majority_label(df.withColumnRenamed("event_id", "event"), "event", "label")


@query("SELECT o_orderpriority, c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def dimension_lookup(spark, d):
    from ..sources.adapters import read

    o, c, n = (read(spark, d, x) for x in ("orders", "customer", "nation"))
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return df.groupBy("o_orderpriority", "c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY 1")
def semi_anti(spark, d):
    from ..sources.adapters import read

    ev = read(spark, d, "events")
    bad = ev.where("event_type = 'error' and value > 100").select("user_id").distinct()
    return ev.where("event_type = 'view'").join(bad, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
