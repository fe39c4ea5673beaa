"""Expressions and features."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import windows as W
from ..operators import features
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide, read
from .base import query, r6

S = W.Series()
PORTS = W.Series(by=("port",), order=("us",))
EV_ORDER = "PARTITION BY entity ORDER BY ts, event_id"
TOTALS_SQL = """tot AS (SELECT *, INOCTETS + OUTOCTETS AS traffic_total, INUCASTPKTS + OUTUCASTPKTS AS ucast_total, INERRORS + OUTERRORS AS errors_total,
  INDISCARDS + OUTDISCARDS AS discards_total, INBROADCASTPKTS + OUTBROADCASTPKTS AS broadcast_total, INMULTICASTPKTS + OUTMULTICASTPKTS AS multicast_total FROM wide)"""
RATIOS_SQL = """feat AS (SELECT *, CASE WHEN ucast_total > 0 THEN errors_total / ucast_total ELSE 0 END AS error_rate, CASE WHEN ucast_total > 0 THEN discards_total / ucast_total ELSE 0 END AS discard_rate,
  CASE WHEN ucast_total > 0 THEN broadcast_total / ucast_total ELSE 0 END AS broadcast_ratio, CASE WHEN ucast_total > 0 THEN traffic_total / ucast_total ELSE 0 END AS avg_packet_size,
  CASE WHEN INOCTETS + OUTOCTETS > 0 THEN (INOCTETS - OUTOCTETS) / (INOCTETS + OUTOCTETS) ELSE 0 END AS in_out_asymmetry FROM tot)"""


@query(f"WITH {WIDE_SQL}, {TOTALS_SQL} SELECT port, us, round(traffic_total, 4) AS traffic_total, ucast_total, errors_total, discards_total, broadcast_total, multicast_total FROM tot")
def traffic_totals(spark, d):
    df = features.traffic_totals(ev_wide(spark, d))
    return df.select("port", "us", r6(F.col("traffic_total"), 4).alias("traffic_total"), "ucast_total", "errors_total", "discards_total", "broadcast_total", "multicast_total")


@query(
    f"WITH {WIDE_SQL}, {TOTALS_SQL}, {RATIOS_SQL} SELECT port, us, round(error_rate, 6) AS error_rate, round(discard_rate, 6) AS discard_rate, round(broadcast_ratio, 6) AS broadcast_ratio, "
    "round(avg_packet_size, 4) AS avg_packet_size, round(in_out_asymmetry, 6) AS in_out_asymmetry FROM feat"
)
def safe_ratios(spark, d):
    df = features.traffic_ratios(features.traffic_totals(ev_wide(spark, d)))
    return df.select("port", "us", *(r6(F.col(c)).alias(c) for c in ("error_rate", "discard_rate", "broadcast_ratio")), r6(F.col("avg_packet_size"), 4).alias("avg_packet_size"), r6(F.col("in_out_asymmetry")).alias("in_out_asymmetry"))


_RATE = """
st AS (SELECT *, value - lag(value) OVER (PARTITION BY entity ORDER BY ts, event_id) AS dv, (us - lag(us) OVER (PARTITION BY entity ORDER BY ts, event_id)) / 1e6 AS dt,
  (min(us) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us) / 1e6 AS nx FROM ev)"""


@query(f"WITH {EV_SQL}, {_RATE} SELECT entity, event_id, round(greatest(coalesce(dv, 0), 0) / coalesce(CASE WHEN dt > 0 THEN dt ELSE nx END, 300), 6) AS rate FROM st")
def counter_rate(spark, d):
    df = features.counter_rates(ev_series(spark, d), S, {"rate": "value"})
    return df.select("entity", "event_id", r6(F.col("rate")).alias("rate"))


@query(
    f"WITH {WIDE_SQL} SELECT port, us, round(INOCTETS + OUTOCTETS, 4) AS traffic_total, round(INERRORS / (INUCASTPKTS + OUTUCASTPKTS + 1), 6) AS error_rate, "
    "round(OUTOCTETS / (INOCTETS + OUTOCTETS + 1e-9), 6) AS tx_ratio, round(INDISCARDS / (INUCASTPKTS + 1), 6) AS rx_drop_rate, round(INOCTETS / 1e6, 8) AS in_mb, round(INOCTETS - OUTOCTETS, 4) AS rx_tx_delta FROM wide"
)
def workshop_composites(spark, d):
    df = ev_wide(spark, d)
    new = features.composites(F.col("INOCTETS"), F.col("OUTOCTETS"), F.col("INERRORS"), F.col("INUCASTPKTS") + F.col("OUTUCASTPKTS"))
    new |= {"rx_drop_rate": C.plus_one_div(F.col("INDISCARDS"), F.col("INUCASTPKTS")), "in_mb": F.col("INOCTETS") / 1e6, "rx_tx_delta": F.col("INOCTETS") - F.col("OUTOCTETS")}
    digits = {"traffic_total": 4, "in_mb": 8, "rx_tx_delta": 4}
    return df.select("port", "us", *(r6(c, digits.get(n, 6)).alias(n) for n, c in new.items()))


@query(f"WITH {EV_SQL} SELECT entity, event_id, " + ", ".join(f"lag(value, {n}) OVER ({EV_ORDER}) AS value_lag_{n}" for n in (1, 3, 5, 6, 12, 15)) + f", value - lag(value, 6) OVER ({EV_ORDER}) AS diff_6 FROM ev".replace("value - lag(value, 6)", "round(value - lag(value, 6)").replace(") AS diff_6", "), 6) AS diff_6"))
def lag_features(spark, d):
    steps = (1, 3, 5, 6, 12, 15)
    df = features.lags(ev_series(spark, d), "value", S, steps, (6,))
    return df.select("entity", "event_id", *(f"value_lag_{n}" for n in steps), r6(F.col("value_diff_6")).alias("diff_6"))


@query(
    f"WITH {EV_SQL}, m AS (SELECT entity, min(value) AS lo, max(value) AS hi FROM ev GROUP BY entity) "
    "SELECT event_id, round((value - lo) / (hi - lo + 1e-9), 6) AS value_scaled FROM ev JOIN m USING (entity)"
)
def minmax_scale(spark, d):
    df = C.min_max_scale(ev_series(spark, d), ["value"], by=["entity"])
    return df.select("event_id", r6(F.col("value_scaled")).alias("value_scaled"))


@query(
    f"""WITH {EV_SQL} SELECT event_id, least(greatest(value, 5.0), 200.0) AS clipped, round(ln(1 + value), 6) AS log_value, round(sqrt(value), 6) AS root, round(abs(value - 50), 6) AS away,
    round(exp(-value / 100), 6) AS decay, round(value / 1e6, 8) AS scaled, value BETWEEN 10 AND 20 AS in_band, entity IN ('click', 'view') AS is_read, NOT (entity = 'error' OR value > 100) AS calm FROM ev"""
)
def scalar_maths(spark, d):
    v = F.col("value")
    return ev_series(spark, d).select(
        "event_id", C.clip(v, 5.0, 200.0).alias("clipped"), r6(F.log1p(v)).alias("log_value"), r6(F.sqrt(v)).alias("root"), r6(F.abs(v - 50)).alias("away"), r6(F.exp(-v / 100)).alias("decay"),
        r6(v / 1e6, 8).alias("scaled"), v.between(10, 20).alias("in_band"), F.col("entity").isin("click", "view").alias("is_read"), (~((F.col("entity") == "error") | (v > 100))).alias("calm"),
    )


@query("SELECT user_id, split_part(event_type, 'i', 1) AS head, lower(event_type) AS low, event_type LIKE '%ic%' AS has_ic, starts_with(event_type, 'view') AS is_view, regexp_full_match(event_type, 'c.*|p.*') AS matched, count(*) AS n FROM events GROUP BY ALL")
def text_functions(spark, d):
    e = F.col("event_type")
    df = read(spark, d, "events").select(
        "user_id", F.split_part(e, F.lit("i"), F.lit(1)).alias("head"), F.lower(e).alias("low"), C.any_keyword(e, ["IC"]).alias("has_ic"), e.startswith("view").alias("is_view"), C.matches(e, "c.*|p.*").alias("matched")
    )
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {EV_SQL} SELECT event_id, isodow(ts) - 1 AS weekday, hour(ts)::INT AS hour, (minute(ts) // 5)::INT AS slot, concat_ws('-', isodow(ts) - 1, hour(ts), minute(ts) // 5) AS slot_key,
    us // 1000000 AS epoch_s, us // 1000 AS epoch_ms, epoch_us(time_bucket(INTERVAL '15 minutes', ts)) AS bucket, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
    greatest(5, (us // 60000000) % 60 + 5) AS minutes FROM ev"""
)
def time_functions(spark, d):
    t = F.col("ts").cast("timestamp")
    us = F.col("us")
    week, hour, slot = F.weekday(t), F.hour(t), F.floor(F.minute(t) / 5).cast("int")
    return ev_series(spark, d).select(
        "event_id", week.cast("long").alias("weekday"), hour.alias("hour"), slot.alias("slot"), F.concat_ws("-", week, hour, slot).alias("slot_key"), F.unix_seconds(t).alias("epoch_s"), F.unix_millis(t).alias("epoch_ms"),
        (F.floor(us / 900_000_000) * 900_000_000).alias("bucket"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.greatest(F.lit(5), F.floor(us / 60_000_000) % 60 + 5).alias("minutes"),
    )


@query(f"WITH {EV_SQL} SELECT entity, event_id, round(CASE WHEN m <> 0 THEN value / m END, 6) AS ratio, round(CASE WHEN m <> 0 THEN (value - m) / m END, 6) AS away, round(value / (m + 1), 6) AS burst FROM (SELECT *, avg(value) OVER ({EV_ORDER} ROWS 11 PRECEDING) AS m FROM ev)")
def relative_features(spark, d):
    v, m = F.col("value"), F.col("m")
    ratio, away = C.relative(v, m)
    df = ev_series(spark, d).withColumn("m", W.roll_mean(v, S, 12, 1))
    return df.select("entity", "event_id", r6(ratio).alias("ratio"), r6(away).alias("away"), r6(C.plus_one_div(v, m)).alias("burst"))


@query(f"WITH {EV_SQL} SELECT entity, event_id, value, value - lag(value, 1) OVER ({EV_ORDER}) > 0 AS rising FROM ev QUALIFY lag(value, 1) OVER ({EV_ORDER}) IS NOT NULL")
def custom_features(spark, d):
    registry = features.FeatureRegistry()
    registry.add("rising", W.difference(F.col("value"), S) > 0)
    return registry.export(ev_series(spark, d), ["entity", "event_id", "value"])


@query(
    f"""WITH {EV_SQL} SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 0.0 ELSE value END AS finite, round_even(value, 0) AS even_0, round_even(value * 2, 0) / 2 AS even_half FROM ev"""
)
def cleaned_values(spark, d):
    """NaN, infinity and null become 0; rounding has ties to even."""
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value"))
    return ev_series(spark, d).select("event_id", C.finite_or_zero(odd).alias("finite"), C.half_even(F.col("value"), 0).alias("even_0"), (C.half_even(F.col("value") * 2, 0) / 2).alias("even_half"))


@query(f"WITH {WIDE_SQL} SELECT port, us, INUCASTPKTS + OUTUCASTPKTS + INBROADCASTPKTS + OUTBROADCASTPKTS + INMULTICASTPKTS + OUTMULTICASTPKTS AS packets FROM wide")
def packet_columns(spark, d):
    """The sum of all columns whose names end alike."""
    df = ev_wide(spark, d)
    return df.select("port", "us", sum((F.col(c) for c in C.columns_with(df, suffix="PKTS")), F.lit(0).cast("long")).alias("packets"))


_DEVICE = "(['lo', 'docker0', 'eth0', 'veth1a', 'br-7f', 'vboxnet0', 'enp3s0', 'local'])[user_id % 8 + 1]"


_LOCAL = " OR ".join(f"starts_with({_DEVICE}, '{p}')" for p in ("lo", "docker", "veth", "br-", "vbox"))


@query(f"SELECT {_DEVICE} AS device, count(*) AS n FROM events WHERE NOT ({_LOCAL}) GROUP BY 1")
def network_devices(spark, d):
    """Rows of devices that aren't the host's own."""
    names = F.array(*map(F.lit, ("lo", "docker0", "eth0", "veth1a", "br-7f", "vboxnet0", "enp3s0", "local")))
    df = read(spark, d, "events").select(F.get(names, (F.col("user_id") % 8).cast("int")).alias("device"))
    return df.where(~C.is_local_device(F.col("device"))).groupBy("device").agg(F.count(F.lit(1)).alias("n"))
