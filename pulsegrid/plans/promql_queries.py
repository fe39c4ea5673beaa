"""Forms of the live path: selectors, rates, ranges, aggregations, recording rules."""

from pyspark.sql import functions as F

from ..operators import promql
from ..sources.adapters import EV_SQL, WIDE_SQL, ev_series, ev_wide
from .base import query, r6
from .join_queries import HOUR, T0

DAY = 24 * HOUR
#: Narrow samples: metric ev_value, labels type and slot; one series for each pair.
SM_SQL = f"{EV_SQL}, sm AS (SELECT entity AS type, (user_id % 4)::VARCHAR AS slot, us, value, event_id FROM ev)"


def samples(spark, d):
    labels = F.create_map(F.lit("type"), F.col("entity"), F.lit("slot"), (F.col("user_id") % 4).cast("string"))
    return ev_series(spark, d).select(F.lit("ev_value").alias("metric"), labels.alias("labels"), "us", "value", "event_id")


@query(f"WITH {SM_SQL} SELECT 'slot=' || slot || ',type=' || type AS series, arg_max(value, us) AS value, max(us) AS us FROM sm WHERE us <= {T0 + 15 * DAY} AND us > {T0 + 14 * DAY} AND type <> 'error' AND regexp_full_match(type, 'c.*|v.*') AND NOT regexp_full_match(slot, '3') GROUP BY ALL")
def pq_instant(spark, d):
    chosen = promql.select(samples(spark, d), "ev_value", ("type", "!=", "error"), ("type", "=~", "c.*|v.*"), ("slot", "!~", "3"))
    return promql.instant(chosen, T0 + 15 * DAY, 86400).select("series", "value", "us")


@query(
    f"""WITH {SM_SQL}, u AS (SELECT *, value - lag(value) OVER (PARTITION BY type, slot ORDER BY us) AS st FROM sm), v AS (SELECT *, CASE WHEN st < 0 THEN value ELSE st END AS up FROM u),
    w AS (SELECT *, sum(up) OVER r - coalesce(first_value(up) OVER r, 0) AS rise, (us - min(us) OVER r) / 1e6 AS took FROM v WINDOW r AS (PARTITION BY type, slot ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW))
    SELECT event_id, round(CASE WHEN took > 0 THEN rise / took END, 8) AS rate FROM w"""
)
def pq_rate(spark, d):
    return promql.rate(samples(spark, d), 6 * 3600, keep=["event_id"]).select("event_id", r6(F.col("rate"), 8).alias("rate"))


@query(
    f"""WITH {SM_SQL}, p AS (SELECT *, lag(value) OVER o AS pv, lag(us) OVER o AS pu FROM sm WINDOW o AS (PARTITION BY type, slot ORDER BY us, event_id)), t AS (SELECT unnest(range({T0}, {T0 + 30 * DAY} + 1, {6 * HOUR})) AS t),
    w AS (SELECT type, slot, t, count(*) AS n, min(us) AS a, max(us) AS b, arg_min(value, row(us, event_id)) AS x, arg_max(value, row(us, event_id)) AS y, coalesce(sum(pv) FILTER (pu > t - {12 * HOUR} AND value < pv), 0) AS lost FROM p JOIN t ON us > t - {12 * HOUR} AND us <= t GROUP BY ALL),
    r AS (SELECT *, (b - a) / 1e6 AS sampled, y - x + lost AS rise, (b - a) / 1e6 / (n - 1) AS mean, (a - (t - {12 * HOUR})) / 1e6 AS ga, (t - b) / 1e6 AS gb FROM w WHERE n > 1 AND b > a),
    e AS (SELECT *, CASE WHEN ga >= 1.1 * mean THEN mean / 2 ELSE ga END AS s, CASE WHEN gb >= 1.1 * mean THEN mean / 2 ELSE gb END AS z FROM r)
    SELECT 'slot=' || slot || ',type=' || type AS series, t AS us, round(rise * ((sampled + CASE WHEN rise > 0 AND x >= 0 THEN least(s, sampled * (x / rise)) ELSE s END + z) / sampled) / 43200, 8) AS rate FROM e"""
)
def pq_rate_at(spark, d):
    """rate(ev_value[12h]) every six hours, with resets, gaps and extrapolation to the ends of the range."""
    df = promql.rate_at(samples(spark, d), 12 * 3600, T0, T0 + 30 * DAY, 6 * HOUR)
    return df.select("series", "us", r6(F.col("rate"), 8).alias("rate"))


def _narrow(spark, d, columns, label=None):
    """Vectors of the hourly counters: labels port and direction (and the counter's name under `label`)."""
    one = lambda c: F.struct(F.create_map(*(F.lit(x) if isinstance(x, str) else x for kv in (("port", F.col("port").cast("string")), ("site", F.lit("lab")), *(((label, F.lit(c)),) if label else ())) for x in kv)).alias("labels"), F.col(c).cast("double").alias("value"))
    return ev_wide(spark, d).select("us", F.inline(F.array(*map(one, columns))))


@query(f"WITH {WIDE_SQL} SELECT port::VARCHAR AS port, kind, us, round(v / nullif(INUCASTPKTS + OUTUCASTPKTS, 0), 6) AS rate FROM (SELECT *, unnest(['INERRORS', 'INDISCARDS']) AS kind, unnest([INERRORS, INDISCARDS]) AS v FROM wide) WHERE INUCASTPKTS + OUTUCASTPKTS > 0")
def pq_error_rate(spark, d):
    """Errors and discards per unicast packet from narrow series: many counters by one total, matched by their labels but for the kind."""
    packets = promql.match_vectors(_narrow(spark, d, ["INUCASTPKTS"]), "+", _narrow(spark, d, ["OUTUCASTPKTS"]))
    out = promql.match_vectors(_narrow(spark, d, ["INERRORS", "INDISCARDS"], "kind"), "/", packets, ignoring=["kind"], many="left")
    label = lambda n: F.element_at("labels", F.lit(n)).alias(n)
    return out.where("value is not null").select(label("port"), label("kind"), "us", r6(F.col("value")).alias("rate"))


@query(f"WITH {SM_SQL}, l AS (SELECT type, slot, us - us % {DAY} AS step, arg_max(value, us) AS value FROM sm GROUP BY ALL) SELECT step, type, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, count(value) AS count FROM l GROUP BY step, type")
def pq_sum_by(spark, d):
    df = promql.aggregate_by(samples(spark, d), ["type"], step_us=DAY)
    return df.select("step", "type", r6(F.col("sum"), 4).alias("sum"), r6(F.col("avg")).alias("avg"), "max", "min", "count")


@query(f"WITH {SM_SQL}, l AS (SELECT type, slot, us - us % {DAY} AS step, arg_max(value, us) AS value FROM sm GROUP BY ALL), g AS (SELECT step, type, round(sum(value), 4) AS sum FROM l GROUP BY step, type), k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY sum DESC, type) AS rank FROM g) SELECT step, type, sum, rank::INT AS rank FROM k WHERE rank <= 2")
def pq_topk(spark, d):
    df = promql.aggregate_by(samples(spark, d), ["type"], step_us=DAY).select("step", "type", r6(F.col("sum"), 4).alias("sum"))
    return promql.topk(df, 2, "step", "sum", "type")


@query(f"WITH {SM_SQL} SELECT event_id, round(avg(value) OVER r, 6) AS avg_over_time, round(stddev_pop(value) OVER r, 5) AS stddev_over_time, count(value) OVER r AS count_over_time FROM sm WINDOW r AS (PARTITION BY type, slot ORDER BY us RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW)")
def pq_avg_over_time(spark, d):
    df = promql.over_time(samples(spark, d), 12 * 3600, keep=["event_id"])
    return df.select("event_id", r6(F.col("avg_over_time")).alias("avg_over_time"), r6(F.col("stddev_over_time"), 5).alias("stddev_over_time"), "count_over_time")


@query(
    f"""WITH {SM_SQL}, x AS (SELECT *, us / 1e6 - min(us) OVER (PARTITION BY type, slot) / 1e6 AS x FROM sm),
    w AS (SELECT event_id, x, count(*) OVER r AS n, avg(value) OVER r AS my, avg(x) OVER r AS mx, covar_pop(x, value) OVER r AS c, var_pop(x) OVER r AS v FROM x WINDOW r AS (PARTITION BY type, slot ORDER BY us RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW))
    SELECT event_id, round(CASE WHEN v > 1 THEN my + c / v * (x + 1800 - mx) END, 3) AS predicted FROM w WHERE n >= 3"""
)
def pq_predict_linear(spark, d):
    df = promql.predict_linear(samples(spark, d), 24 * 3600, 1800, least_variance=1.0, keep=["event_id"])
    return df.where("count_over_time >= 3").select("event_id", r6(F.col("predicted"), 3).alias("predicted"))


@query("SELECT DISTINCT event_type AS type FROM events")
def label_values(spark, d):
    return promql.label_values(samples(spark, d), "ev_value", "type")


#: The hourly rows as a replay at twelve times their speed hands them out: one every five minutes.
SPEED = 12
_HOURLY = ", ".join(
    f"avg({x}) OVER w AS {n}_mean_1h, stddev_pop({x}) OVER w AS {n}_stddev_1h, round(({x} - avg({x}) OVER w) / greatest(stddev_pop({x}) OVER w, {least}), 9) AS {n}_zscore"
    for n, x, least in (("traffic", "traffic_total", "1.0"), ("error_rate", "error_rate", "0.0001"), ("discard_rate", "discard_rate", "0.0001"), ("broadcast", "broadcast_total", "1.0"))
)
REC_SQL = f"""{WIDE_SQL}, l1 AS (SELECT port, {T0} + (us - {T0}) // {SPEED} AS us, INOCTETS + OUTOCTETS AS traffic_total, INUCASTPKTS + OUTUCASTPKTS AS ucast_total, INERRORS + OUTERRORS AS errors_total, INDISCARDS + OUTDISCARDS AS discards_total, INBROADCASTPKTS + OUTBROADCASTPKTS AS broadcast_total FROM wide),
l2 AS (SELECT *, errors_total / greatest(ucast_total, 1) AS error_rate, discards_total / greatest(ucast_total, 1) AS discard_rate FROM l1),
rec AS (SELECT *, {_HOURLY} FROM l2 WINDOW w AS (PARTITION BY port ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))"""
_ROUNDED = [f"{n}_{k}" for n in ("traffic", "error_rate", "discard_rate", "broadcast") for k in ("mean_1h", "stddev_1h", "zscore")]


def fast_wide(spark, d):
    """The hourly rows as rows of five minutes."""
    return ev_wide(spark, d).withColumn("us", F.lit(T0) + F.expr(f"(us - {T0}) div {SPEED}"))


def _recorded(spark, d):
    return promql.record(fast_wide(spark, d))


def _plain(c, digits):
    """Rounded, with one zero."""
    r = r6(F.col(c), digits)
    return F.when(r == 0, 0.0).otherwise(r).alias(c)


@query(f"WITH {REC_SQL} SELECT port, us, round(traffic_total, 4) AS traffic_total, ucast_total, broadcast_total, round(error_rate, 6) AS error_rate, round(discard_rate, 6) AS discard_rate, " + ", ".join(f"CASE WHEN round({c}, 5) = 0 THEN 0 ELSE round({c}, 5) END AS {c}" for c in _ROUNDED) + " FROM rec")
def recording_rules(spark, d):
    df = _recorded(spark, d)
    return df.select("port", "us", r6(F.col("traffic_total"), 4).alias("traffic_total"), "ucast_total", "broadcast_total", *(r6(F.col(c)).alias(c) for c in ("error_rate", "discard_rate")), *(_plain(c, 5) for c in _ROUNDED))


STATES_SQL = f"""{REC_SQL}, a AS (
  SELECT 'TrafficSurge' AS alert, 'warning' AS severity, 'traffic_surge' AS anomaly_type, 60 AS hold, port, us, coalesce(traffic_zscore > 3, false) AS f FROM rec UNION ALL
  SELECT 'TrafficDrop', 'warning', 'traffic_drop', 120, port, us, coalesce(traffic_zscore < -3, false) FROM rec UNION ALL
  SELECT 'ErrorRateSurge', 'critical', 'error_burst', 60, port, us, coalesce(error_rate_zscore > 3, false) FROM rec UNION ALL
  SELECT 'DiscardRateSurge', 'warning', 'discard_spike', 60, port, us, coalesce(discard_rate_zscore > 3, false) FROM rec UNION ALL
  SELECT 'BroadcastStorm', 'critical', 'broadcast_storm', 30, port, us, coalesce(broadcast_zscore > 3, false) FROM rec),
s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY alert, port ORDER BY us), false) THEN us END AS st FROM a),
t AS (SELECT *, CASE WHEN f THEN last_value(st IGNORE NULLS) OVER (PARTITION BY alert, port ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS since FROM s),
x AS (SELECT *, CASE WHEN NOT f THEN 'inactive' WHEN us - since >= hold * 1000000 THEN 'firing' ELSE 'pending' END AS state FROM t)"""


@query(f"WITH {STATES_SQL} SELECT alert, severity, port, state, count(*) AS n FROM x GROUP BY ALL")
def alert_rules(spark, d):
    return promql.rule_alerts(_recorded(spark, d)).groupBy("alert", "severity", "port", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATES_SQL} SELECT alert, severity, anomaly_type, port, us, since FROM x WHERE state = 'firing'")
def firing_alerts(spark, d):
    """Alerts that fire, and since when their condition has held."""
    df = promql.rule_alerts(_recorded(spark, d)).where("state = 'firing'")
    return df.select("alert", "severity", "anomaly_type", "port", "us", F.col("since_us").alias("since"))


_RECORDED = [*promql.RECORDING_RULES, *_ROUNDED]


@query(
    f"""WITH {STATES_SQL}, n AS (SELECT {', '.join(f'count({c}) AS {c}' for c in ('traffic_total', 'errors_total', 'discards_total', 'ucast_total', 'error_rate', 'discard_rate', 'broadcast_total', *_ROUNDED))} FROM rec)
    SELECT name, 'recording' AS type, rows FROM (UNPIVOT n ON * INTO NAME name VALUE rows) UNION ALL SELECT alert, 'alerting', count(*) FILTER (state <> 'inactive') FROM x GROUP BY alert"""
)
def rule_activity(spark, d):
    """Every rule of the catalog: how many rows a recording rule has a value for, and how many an alert isn't inactive for."""
    recorded = _recorded(spark, d)
    made = recorded.agg(*(F.count(c).alias(c) for c in _RECORDED)).unpivot([], _RECORDED, "name", "rows")
    told = promql.rule_alerts(recorded).groupBy(F.col("alert").alias("name")).agg(F.count(F.when(F.col("state") != "inactive", 1)).alias("rows"))
    return promql.rule_catalog(spark).select("name", "type").join(made.unionByName(told), "name")


@query(f"WITH {STATES_SQL} SELECT alert, anomaly_type, port, us, since, state FROM x WHERE regexp_full_match(alert, '(Traffic|Discard|Error).*') AND state <> 'inactive'")
def active_alerts(spark, d):
    """Pending and firing alerts whose name fits a regex."""
    df = promql.rule_alerts(_recorded(spark, d), "(Traffic|Discard|Error).*").where("state != 'inactive'")
    return df.select("alert", "anomaly_type", "port", "us", F.col("since_us").alias("since"), "state")


@query(
    f"""WITH {SM_SQL}, s AS (SELECT type, us - us % {DAY} AS step, value, us, event_id FROM sm WHERE type <> 'signup')
    SELECT type, step, arg_max(value, (us, event_id)) AS last, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, count(*) AS count FROM s GROUP BY ALL""".replace("(us, event_id))", "row(us, event_id))")
)
def pq_panel(spark, d):
    """What a dashboard panel reduces the range of a selector (a label unlike a value) to, for each day: last, mean, max, min."""
    chosen = promql.select(samples(spark, d), "ev_value", ("type", "!=", "signup"))
    df = promql.reduce_range(chosen.withColumn("type", F.col("labels")["type"]), ["type"], DAY)
    return df.select("type", "step", "last", r6(F.col("mean")).alias("mean"), "max", "min", "count")


@query(f"WITH {SM_SQL}, c AS (SELECT unnest(range({T0}, {T0} + 30 * {DAY}, {DAY})) AS step), k AS (SELECT type, slot, step FROM c, (SELECT DISTINCT type, slot FROM sm)) SELECT k.type, k.slot, k.step, sm.value FROM k ASOF JOIN sm ON k.type = sm.type AND k.slot = sm.slot AND k.step >= sm.us")
def pq_range(spark, d):
    from ..operators.joins import as_of

    sm = samples(spark, d).select(F.concat_ws("/", F.col("labels")["type"], F.col("labels")["slot"]).alias("key"), "us", "value")
    steps = spark.range(T0, T0 + 30 * DAY, DAY).select(F.col("id").alias("us"))
    left = sm.select("key").distinct().join(F.broadcast(steps))  # 30 steps
    out = as_of(left.select("key", "us"), sm, "key", "value")
    return out.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("type"), F.split_part("key", F.lit("/"), F.lit(2)).alias("slot"), F.col("us").alias("step"), F.col("matched").alias("value"))
