"""Sources and sinks, over files that are derived from the driver tables."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import promql
from ..operators.joins import WILDCARD as MULTI
from ..operators.joins import bucket_of, interval_join, time_buckets
from ..sources import generator, readers, sinks
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide, read
from ..sources.scratch import scratch
from .base import query, r6
from .forecast_queries import BAND_SQL, HOURLY_SQL, hourly_forecast
from .join_queries import CAT_SQL, HOUR, T0, catalog

DAY = 86_400
#: Ten days and a bit of the events' month, in seconds since 1970.
_FROM, _TO = 1_704_500_000, 1_705_400_000


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, epoch_us(min(ts)) AS first_us FROM events GROUP BY event_type")
def csv_scan(spark, d):
    path = scratch(spark, "csv")
    df = read(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "event_type", "value")
    df.write.csv(path, header=True)
    back = spark.read.schema("event_id long, timestamp timestamp, event_type string, value double").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.unix_micros(F.min("timestamp")).alias("first_us"))


def _rrd_lines(spark, d):
    path = scratch(spark, "rrd")
    odd = F.when(F.col("event_id") % 7 == 3, F.lit("nan")).otherwise(F.format_string("%.6e", F.col("value")))
    lines = ev_series(spark, d).select(F.concat(F.floor(F.col("us") / 1_000_000).cast("string"), F.lit(": "), odd, F.lit(" "), F.format_string("%.6e", F.col("user_id").cast("double"))).alias("value"))
    head = spark.createDataFrame([("          value user",), ("",), ("bad: row",)], "value string")
    head.unionByName(lines).write.text(path)
    return readers.rrd_fetch(spark, path, ["value", "user"])


@query("WITH r AS (SELECT epoch_us(ts) // 1000000 AS epoch, CASE WHEN event_id % 7 <> 3 THEN value END AS value, user_id::DOUBLE AS u FROM events) SELECT 'value' AS name, count(*) AS n, count(value) AS known, round(sum(value), 1) AS total FROM r UNION ALL SELECT 'user', count(*), count(u), round(sum(u), 1) FROM r")
def rrd_fetch(spark, d):
    return _rrd_lines(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.round(F.sum("value"), 1).alias("total"))


@query(
    f"WITH r AS (SELECT epoch_us(ts) // 1000000 AS epoch, value FROM events WHERE event_id % 7 <> 3), s AS (SELECT epoch - epoch % {DAY} AS step, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(*) AS n FROM r GROUP BY 1) "
    "SELECT 'AVERAGE' AS cf, step, round(a, 3) AS value FROM s UNION ALL SELECT 'MIN', step, round(lo, 3) FROM s UNION ALL SELECT 'MAX', step, round(hi, 3) FROM s"
)
def rrd_consolidate(spark, d):
    df, out = _rrd_lines(spark, d).where("name = 'value'"), None
    for how in ("AVERAGE", "MIN", "MAX"):
        part = readers.consolidate(df, DAY, how).select(F.lit(how).alias("cf"), "step", F.round("value", 3).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH r AS (SELECT epoch_us(ts) // 1000000 AS epoch, value FROM events WHERE event_id % 7 <> 3), b AS (SELECT * FROM r WHERE epoch BETWEEN {_FROM} AND {_TO}) SELECT epoch - epoch % {DAY} AS step, round(arg_max(value, row(epoch, value)), 3) AS value FROM b GROUP BY 1")
def rrd_last(spark, d):
    """The last value of each day between two times, both inside; of one second's values the largest."""
    df = readers.consolidate(_rrd_lines(spark, d).where("name = 'value'"), DAY, "LAST", _FROM, _TO)
    return df.select("step", F.round("value", 3).alias("value"))


@query("SELECT 'ds[' || event_type || '].n' AS key, count(*)::VARCHAR AS value FROM events GROUP BY event_type UNION ALL SELECT 'rrd_version', '0003'")
def rrd_info(spark, d):
    path = scratch(spark, "info")
    n = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    lines = n.select(F.concat(F.lit("ds["), "event_type", F.lit("].n = "), F.col("n").cast("string")).alias("value"))
    lines.unionByName(spark.createDataFrame([('rrd_version = "0003"',), ("no pair here",)], "value string")).write.text(path)
    return readers.rrd_info(spark, path)


@query("SELECT 'ev_total' AS metric, event_type AS type, count(*)::DOUBLE AS value FROM events GROUP BY event_type")
def exposition_text(spark, d):
    path = scratch(spark, "exposition")
    n = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    lines = n.select(F.format_string('ev_total{type="%s",job="x"} %s', "event_type", F.col("n").cast("string")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# HELP ev_total events",), ("# TYPE ev_total counter",)], "value string")).write.text(path)
    return readers.exposition(spark, path).select("metric", F.col("labels")["type"].alias("type"), "value")


@query(f"WITH {WIDE_SQL}, u AS (UNPIVOT (SELECT port, us, INOCTETS, OUTOCTETS, INERRORS::DOUBLE AS INERRORS FROM wide) ON INOCTETS, OUTOCTETS, INERRORS INTO NAME \"column\" VALUE value) SELECT 'hourly' AS source, port, us, \"column\", round(value, 4) AS value FROM u")
def narrow_results(spark, d):
    df = ev_wide(spark, d).select("port", "us", "INOCTETS", "OUTOCTETS", "INERRORS")
    return sinks.narrow_results(df, "hourly", ["port", "us"]).withColumn("value", r6(F.col("value"), 4))


@query("SELECT event_id, event_type, round(value / 1e6, 10) AS value_m, 'demo' AS series FROM events ORDER BY ts DESC, event_id DESC LIMIT 120")
def drop_zone(spark, d):
    df = sinks.drop_zone(read(spark, d, "events"), "value", ["ts", "event_id"], "demo")
    return df.select("event_id", "event_type", r6(F.col("value_m"), 10).alias("value_m"), "series")


@query("WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT '{\"event_type\":\"' || event_type || '\",\"n\":' || n || '}' AS value FROM t")
def json_sink(spark, d):
    path = scratch(spark, "json")
    n = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    n.write.json(path)
    back = spark.read.schema("event_type string, n long").json(path)
    return sinks.incident_json(back, ["event_type", "n"])


@query("SELECT event_id, '{\"time\":' || (epoch_us(ts) // 1000) || ',\"text\":\"' || event_type || '\",\"tags\":[\"anomaly\",\"demo\"]}' AS annotation FROM events WHERE value > 300")
def annotations(spark, d):
    df = ev_series(spark, d).where("value > 300")
    return df.select("event_id", sinks.annotation(F.col("us"), F.col("entity"), "anomaly", "demo").alias("annotation"))


@query(f"WITH {EV_SQL}, {CAT_SQL} SELECT event_id AS row_id, event, round(CASE WHEN event IS NOT NULL THEN value * 3 * (0.8 + 0.2 * (us - start_us) / greatest(end_us - start_us, 1)) ELSE value END, 6) AS injected FROM ev LEFT JOIN cat ON (entity = port OR port = 'MULTI') AND us BETWEEN start_us AND end_us")
def inject_events(spark, d):
    rows = ev_series(spark, d).withColumnRenamed("event_id", "row_id")
    df = generator.inject(rows, catalog(spark), "value", "entity", 3.0)
    return df.select("row_id", F.col("label").alias("event"), r6(F.col("injected")).alias("injected"))


@query(f"WITH {WIDE_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY us DESC) AS rn FROM wide), u AS (UNPIVOT (SELECT port, INOCTETS, INERRORS::DOUBLE AS INERRORS FROM l WHERE rn = 1) ON INOCTETS, INERRORS INTO NAME metric VALUE value) SELECT metric, port::VARCHAR AS port, round(value, 4) AS value FROM u")
def gauge_rows(spark, d):
    from ..operators.joins import latest_at

    latest = latest_at(ev_wide(spark, d).withColumn("event_id", F.lit(0)), 1 << 62, "port")
    df = sinks.gauge_rows(latest, ["INOCTETS", "INERRORS"], ["port"])
    return df.select("metric", F.col("labels")["port"].alias("port"), r6(F.col("value"), 4).alias("value"))


@query(f"WITH {WIDE_SQL} SELECT port::VARCHAR AS port_id, count(*) AS rows, round(sum(INOCTETS), 2) AS in_octets, sum(INERRORS)::BIGINT AS in_errors, max(us) AS last_us FROM wide GROUP BY 1")
def telemetry_scan(spark, d):
    """Telemetry written as a stage (Parquet and CSV) and read again from CSV with its schema."""
    path, wide = scratch(spark, "stage"), ev_wide(spark, d)
    names = {"timestamp": F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss"), "device_id": F.lit("core"), "port_id": F.col("port").cast("string"), "port_role": F.lit("access"), "event_label": F.lit("normal"), "event_id": F.lit("")}
    columns = [(names[f.name] if f.name in names else F.col(f.name) if f.name in wide.columns else F.lit(0)).alias(f.name) for f in readers.TELEMETRY]
    sinks.write_stage(wide.select(*columns), f"{path}/parquet", f"{path}/csv")
    df = readers.telemetry_csv(spark, f"{path}/csv")
    return df.groupBy("port_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("INOCTETS"), 2).alias("in_octets"), F.sum("INERRORS").alias("in_errors"), F.unix_micros(F.max("timestamp")).alias("last_us"))


@query(f"WITH {EV_SQL}, {CAT_SQL} SELECT event, kind, start_us, end_us, count(*) AS n FROM cat JOIN ev ON us BETWEEN start_us AND end_us GROUP BY ALL")
def catalog_scan(spark, d):
    """The event catalog as CSV, whose starts have minutes and ends seconds, and the rows in its intervals."""
    path = scratch(spark, "catalog")
    time = lambda c, pattern: F.date_format(F.timestamp_micros(c), pattern)
    lines = catalog(spark).select("event_id", F.col("kind").alias("event_type"), F.col("port").alias("port_id"), time("start_us", "yyyy-MM-dd HH:mm").alias("start_time"), F.lit(1).alias("periods_5min"), F.lit("").alias("description"), time("end_us", "yyyy-MM-dd HH:mm:ss").alias("end_time"))
    lines.write.csv(path, header=True)
    back = readers.catalog_csv(spark, path).select(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.lit(MULTI).alias("port"), F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))
    df = interval_join(ev_series(spark, d), back, "entity", wildcard=True)
    return df.groupBy("event", "kind", "start_us", "end_us").agg(F.count(F.lit(1)).alias("n"))


#: Intervals of several kinds on the hourly ports; none overlap.
_KINDS = [
    ("A", "business_traffic_growth", "0", 20, 60), ("B", "small_packet_scan", "1", 70, 90), ("C", "large_file_backup", "1", 100, 130), ("D", "queue_congestion", "2", 140, 170), ("E", "link_quality_issue", "3", 180, 210),
    ("F", "load_sensitive_link_issue", "4", 220, 260), ("G", "broadcast_storm", "MULTI", 300, 330), ("H", "multicast_flooding", "MULTI", 340, 370), ("I", "abnormal_device_sender", "0", 400, 440), ("J", "unknown_protocol_scan", "1", 450, 480),
]


@query(
    f"""WITH {WIDE_SQL}, k(event, kind, p, a, b) AS (VALUES {', '.join(f"('{e}', '{k}', '{p}', {T0 + x * HOUR}, {T0 + y * HOUR})" for e, k, p, x, y in _KINDS)}),
    m AS (SELECT wide.*, event, kind, (us - a) / greatest(b - a, 1) AS r FROM wide LEFT JOIN k ON (p = port::VARCHAR OR p = 'MULTI') AND us BETWEEN a AND b)
    SELECT port, us, coalesce(kind, 'normal') AS event_label, coalesce(event, '') AS event_id,
      round(INOCTETS * (CASE event WHEN 'A' THEN 1.9 WHEN 'B' THEN 1.25 WHEN 'C' THEN 5.2 WHEN 'D' THEN 3.8 WHEN 'F' THEN 2.8 ELSE 1 END)::DOUBLE, 4) AS INOCTETS,
      round(OUTUCASTPKTS * (CASE event WHEN 'A' THEN 1.9 WHEN 'B' THEN 8 WHEN 'C' THEN 2 WHEN 'D' THEN 3.8 WHEN 'I' THEN 5.5 ELSE 1 END)::DOUBLE, 4) AS OUTUCASTPKTS,
      (INERRORS + CASE WHEN event = 'E' THEN 180 + round(100 * (0.8 + 0.2 * r)) WHEN event = 'F' AND r >= 0.35 THEN 120 + round(120 * (0.5 + 0.7 * (r - 0.35) / 0.65)) ELSE 0 END)::DOUBLE AS INERRORS,
      (INDISCARDS + CASE event WHEN 'D' THEN round(600 * (0.8 + 0.2 * r)) WHEN 'G' THEN 80 WHEN 'H' THEN 45 ELSE 0 END)::DOUBLE AS INDISCARDS,
      (INBROADCASTPKTS * CASE event WHEN 'G' THEN 18 ELSE 1 END)::DOUBLE AS INBROADCASTPKTS, (INUNKNOWNPROTOS + CASE event WHEN 'J' THEN 440 ELSE 0 END)::DOUBLE AS INUNKNOWNPROTOS FROM m"""
)
def inject_kinds(spark, d):
    """Events of ten kinds injected into the counters, with means in place of draws."""
    kinds = spark.createDataFrame([(e, k, p, T0 + x * HOUR, T0 + y * HOUR) for e, k, p, x, y in _KINDS], "event_id string, kind string, port string, start_us long, end_us long")
    df = generator.inject_kinds(ev_wide(spark, d).withColumnRenamed("port", "row_port"), kinds, "row_port", seed=None)
    exact = [F.col(c).cast("double").alias(c) for c in ("INERRORS", "INDISCARDS", "INBROADCASTPKTS", "INUNKNOWNPROTOS")]
    return df.select(F.col("row_port").alias("port"), "us", "event_label", "event_id", *(r6(F.col(c).cast("double"), 4).alias(c) for c in ("INOCTETS", "OUTUCASTPKTS")), *exact)


@query(
    f"""WITH {WIDE_SQL}, {CAT_SQL}, g AS (SELECT wide.*, coalesce(kind, 'normal') AS event FROM wide LEFT JOIN cat ON cat.port = 'MULTI' AND us BETWEEN start_us AND end_us),
    u AS (UNPIVOT (SELECT port, us, event, INOCTETS, OUTOCTETS, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('INUCASTPKTS', 'OUTUCASTPKTS', 'INERRORS', 'OUTERRORS', 'INDISCARDS', 'OUTDISCARDS', 'INBROADCASTPKTS', 'OUTBROADCASTPKTS', 'INMULTICASTPKTS', 'OUTMULTICASTPKTS'))} FROM g) ON COLUMNS(* EXCLUDE (port, us, event)) INTO NAME metric VALUE value)
    SELECT metric, port::VARCHAR AS port, event, count(*) AS n, round(max(value), 4) AS max, round(avg(value), 5) AS mean FROM u WHERE event <> 'normal' GROUP BY ALL"""
)
def dashboard_counters(spark, d):
    """The twelve counters of a dashboard where the event label isn't normal, with the reducers of its panels."""
    counters = [f"{way}{c}" for c in ("OCTETS", "UCASTPKTS", "ERRORS", "DISCARDS", "BROADCASTPKTS", "MULTICASTPKTS") for way in ("IN", "OUT")]
    times = time_buckets(catalog(spark).where(F.col("port") == MULTI).select("kind", "start_us", "end_us"))
    wide = ev_wide(spark, d).join(times, (bucket_of(F.col("us")) == F.col("_bucket")) & F.col("us").between(F.col("start_us"), F.col("end_us")), "left")
    rows = sinks.gauge_rows(wide.withColumn("event", F.coalesce("kind", F.lit("normal"))), counters, ["port", "event"])
    chosen = [promql.select(rows, c, ("event", "!=", "normal")) for c in counters]
    df = reduce(lambda a, b: a.unionByName(b), chosen)
    return df.groupBy("metric", F.col("labels")["port"].alias("port"), F.col("labels")["event"].alias("event")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("value"), 4).alias("max"), r6(F.avg("value"), 5).alias("mean"))


@query(f"WITH {EV_SQL}, {HOURLY_SQL}, {BAND_SQL} SELECT entity, us, c AS \"column\", round(v + 1e-9, 4) AS value FROM (SELECT entity, us, unnest(['y_hat', 'y_hat_lower', 'y_hat_upper']) AS c, unnest([y_hat, greatest(y_hat - band, 0), y_hat + band]) AS v FROM o) WHERE v IS NOT NULL")
def inferred_results(spark, d):
    """The forecast's results in narrow form, under the columns that a table's own schema ranks first."""
    df = hourly_forecast(spark, d).select("entity", "us", "x", "slot", "y_hat", F.col("y_lower").alias("y_hat_lower"), F.col("y_upper").alias("y_hat_upper"))
    return sinks.narrow_results(df, "forecast", ["entity", "us"]).select("entity", "us", "column", F.round(F.col("value") + 1e-9, 4).alias("value"))
