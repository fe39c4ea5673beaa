"""Alerts and root causes."""

import json

from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.columns import lookup
from ..operators import alerts, detect, rca
from ..sources.adapters import EV_SQL, ev_series
from .base import query, r6
from .detector_queries import BY_TS, CP_SQL, FLAGS_SQL, Z_SQL, flag_table
from .forecast_queries import BAND_SQL, HOURLY_SQL, hourly_forecast
from ..operators.joins import WILDCARD as MULTI
from ..operators.joins import bucket_of, time_buckets
from .join_queries import CAT_SQL, HOUR, LABELLED_SQL, T0, catalog, labelled_telemetry

S = W.Series()
_NAMES = [f"{m}__flag_{n}" for m, way in detect.DIRECTIONS.items() for n in (["z_high", "rz_high", "p95"] + (["z_low", "rz_low"] if way == "both" else []))]
RAW_SQL = f"flags AS ({FLAGS_SQL}), raw AS (SELECT port, us, split_part(alert_name, '__flag_', 1) AS metric, alert_name, us - us % 900000000 AS bucket FROM (UNPIVOT flags ON {', '.join(_NAMES)} INTO NAME alert_name VALUE f) WHERE f = 1)"


def _raw(spark, d):
    return alerts.raw_alerts(flag_table(spark, d).select("port", "us", *_NAMES), ["port", "us"])


@query(f"WITH {RAW_SQL} SELECT * FROM raw")
def raw_alerts(spark, d):
    return _raw(spark, d)


@query(f"WITH {RAW_SQL} SELECT alert_name, count(*) AS n, round(count(*) / (SELECT count(*) FROM flags), 6) AS rate FROM raw GROUP BY 1")
def flag_rates(spark, d):
    flags = flag_table(spark, d).select(*_NAMES)
    wide = flags.agg(*(F.sum(c).alias(c) for c in _NAMES), F.count(F.lit(1)).alias("_rows"))
    long = wide.unpivot(["_rows"], _NAMES, "alert_name", "n").where("n > 0")
    return long.select("alert_name", "n", r6(F.col("n") / F.col("_rows")).alias("rate"))


@query(f"WITH {RAW_SQL}, c AS (SELECT us - us % {HOUR} AS hour, count(*) AS n FROM raw GROUP BY 1) SELECT s.hour, coalesce(n, 0) AS alerts FROM (SELECT unnest(range(min(hour), max(hour) + 1, {HOUR})) AS hour FROM c) s LEFT JOIN c USING (hour)")
def alerts_hourly(spark, d):
    return alerts.hourly_volume(_raw(spark, d))


_RED = "red AS (SELECT bucket, alert_name, min(us) AS start_us, max(us) AS end_us, 'General anomaly' AS problem_type, string_agg(DISTINCT port::VARCHAR, ',' ORDER BY port::VARCHAR) AS affected_ports, count(DISTINCT port)::INT AS affected_port_count, string_agg(DISTINCT metric, ',' ORDER BY metric) AS evidence_metrics, count(*) AS raw_alert_count, least(100, 20 + 8 * count(*) + 15 * count(DISTINCT port) + 12 * count(DISTINCT metric))::INT AS severity_score FROM raw GROUP BY bucket, alert_name)"


@query(f"WITH {RAW_SQL}, {_RED} SELECT * FROM red")
def reduced_alerts(spark, d):
    return alerts.reduce_alerts(_raw(spark, d))


_SHORT = "CASE metric WHEN 'traffic_total' THEN 'traffic' WHEN 'error_rate' THEN 'errors' WHEN 'discard_rate' THEN 'discards' WHEN 'broadcast_total' THEN 'broadcast' WHEN 'avg_packet_size' THEN 'packets' END"
_KIND = """CASE
    WHEN list_contains(metrics, 'broadcast') AND len(ports) > 1 THEN 'Broadcast storm / L2 loop'
    WHEN list_contains(metrics, 'multicast') AND len(ports) > 1 THEN 'Multicast flooding'
    WHEN list_contains(metrics, 'traffic') AND list_contains(metrics, 'discards') AND NOT list_contains(metrics, 'errors') THEN 'Queue congestion'
    WHEN list_contains(metrics, 'discards') THEN 'Queue / buffer pressure'
    WHEN list_contains(metrics, 'errors') AND NOT list_contains(metrics, 'traffic') THEN 'Link quality issue'
    WHEN list_contains(metrics, 'unknown_protocol') THEN 'Unknown protocol / scan'
    WHEN list_contains(metrics, 'packets') AND list_contains(metrics, 'traffic') THEN 'Traffic or packet surge'
    WHEN list_contains(metrics, 'packets') THEN 'Packet surge / possible scan'
    WHEN list_contains(metrics, 'traffic') THEN 'Traffic surge / capacity pressure'
    WHEN list_contains(metrics, 'broadcast') THEN 'Broadcast anomaly'
    WHEN list_contains(metrics, 'multicast') THEN 'Multicast anomaly'
    ELSE 'General anomaly' END"""
_BY_TYPE = (
    f"g AS (SELECT bucket, min(us) AS start_us, max(us) AS end_us, count(*) AS raw_alert_count, list_sort(list(DISTINCT port::VARCHAR)) AS ports, list_sort(list(DISTINCT {_SHORT})) AS metrics FROM raw GROUP BY 1), "
    f"bt AS (SELECT bucket, start_us, end_us, {_KIND} AS problem_type, array_to_string(ports, ',') AS affected_ports, len(ports)::INT AS affected_port_count, array_to_string(metrics, ',') AS evidence_metrics, raw_alert_count, least(100, 20 + 8 * raw_alert_count + 15 * len(ports) + 12 * len(metrics))::INT AS severity_score FROM g)"
)


@query(f"WITH {RAW_SQL}, {_BY_TYPE} SELECT * FROM bt")
def reduced_alerts_by_type(spark, d):
    return alerts.reduce_alerts(_raw(spark, d), mode="intended")


@query(f"WITH {RAW_SQL}, {_BY_TYPE} SELECT problem_type, start_us - start_us % {24 * HOUR} AS day_us, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS events, sum(raw_alert_count)::BIGINT AS raw_alert_count, max(severity_score) AS severity_score FROM bt GROUP BY 1, 2")
def alerts_by_type_and_day(spark, d):
    return alerts.merge_by_type(alerts.reduce_alerts(_raw(spark, d), mode="intended"))


@query(
    f"WITH {RAW_SQL}, {CAT_SQL}, l AS (SELECT raw.*, coalesce(kind, 'normal') AS event_label FROM raw LEFT JOIN cat ON cat.port = 'MULTI' AND us BETWEEN start_us AND end_us) "
    "SELECT bucket, alert_name, count(*) AS raw_alert_count, string_agg(DISTINCT event_label, ',' ORDER BY event_label) AS event_labels FROM l GROUP BY 1, 2"
)
def reduced_alert_labels(spark, d):
    """Reduced alerts with the labels that their time has in the catalog; most are normal."""
    times = catalog(spark).where(F.col("port") == MULTI).drop("port")
    raw = _raw(spark, d).join(time_buckets(times), (bucket_of(F.col("us")) == F.col("_bucket")) & F.col("us").between(F.col("start_us"), F.col("end_us")), "left")
    labelled = raw.select("port", "us", "metric", "alert_name", "bucket", F.coalesce("kind", F.lit("normal")).alias("event_label"))
    return alerts.reduce_alerts(labelled, label="event_label").select("bucket", "alert_name", "raw_alert_count", "event_labels")


@query(f"WITH {RAW_SQL}, {_RED} SELECT (SELECT count(*) FROM raw) AS raw_alerts, (SELECT count(*) FROM red) AS reduced_alerts, round((SELECT count(*) FROM raw) / (SELECT count(*) FROM red), 4) AS ratio")
def reduction_ratio(spark, d):
    df = alerts.reduce_alerts(_raw(spark, d)).agg(F.sum("raw_alert_count").alias("raw_alerts"), F.count(F.lit(1)).alias("reduced_alerts"))
    return df.withColumn("ratio", r6(F.col("raw_alerts") / F.col("reduced_alerts"), 4))


@query(f"WITH {RAW_SQL} SELECT port, us, alert_name FROM raw WHERE NOT EXISTS (SELECT 1 FROM (VALUES ({T0 + 100 * HOUR}, {T0 + 130 * HOUR})) m(a, b) WHERE us BETWEEN a AND b)")
def suppressed_alerts(spark, d):
    planned = spark.createDataFrame([(T0 + 100 * HOUR, T0 + 130 * HOUR)], "start_us long, end_us long")
    return alerts.suppress(_raw(spark, d).select("port", "us", "alert_name"), planned)


_RCA = "rca AS (SELECT *, 'General network anomaly' AS root_cause_candidate, least(100, severity_score + 3 + 4 * affected_port_count) AS root_cause_score, 'Review metric trend, affected ports, recent changes' AS evidence, greatest(5, (end_us - start_us) // 60000000 + 5) AS duration_minutes FROM red)"
_CONF = "CASE WHEN root_cause_score >= 85 THEN 'High' WHEN root_cause_score >= 65 THEN 'Medium' ELSE 'Low' END"


def _rca(spark, d):
    return rca.candidates(alerts.reduce_alerts(_raw(spark, d)))


@query(
    f"WITH {RAW_SQL}, {_RED}, {_RCA} SELECT printf('RCA-%03d', row_number() OVER (ORDER BY start_us, severity_score DESC, alert_name)) AS rca_event_id, start_us, alert_name, root_cause_candidate, evidence, duration_minutes, root_cause_score::INT AS root_cause_score, {_CONF} AS confidence FROM rca"
)
def rca_events(spark, d):
    """Every reduced alert as an event, numbered by start and severity."""
    return rca.number_events(_rca(spark, d)).select("rca_event_id", "start_us", "alert_name", "root_cause_candidate", "evidence", "duration_minutes", "root_cause_score", "confidence")


@query(f"WITH {RAW_SQL}, {_RED}, {_RCA} SELECT root_cause_candidate, {_CONF} AS confidence, count(*) AS n, round(avg(root_cause_score), 4) AS mean_score, max(root_cause_score)::INT AS max_score FROM rca GROUP BY ALL")
def rca_summary(spark, d):
    return _rca(spark, d).groupBy("root_cause_candidate", "confidence").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("root_cause_score"), 4).alias("mean_score"), F.max("root_cause_score").alias("max_score"))


def _by_type(spark, d):
    return rca.candidates(alerts.reduce_alerts(_raw(spark, d), mode="intended"))


_CAND = """CASE
    WHEN contains(problem_type, 'Queue congestion') OR contains(problem_type, 'Queue / buffer') THEN 'Queue congestion / buffer pressure'
    WHEN contains(problem_type, 'Broadcast') THEN 'Broadcast storm / L2 loop'
    WHEN contains(problem_type, 'Multicast') THEN 'Multicast flooding'
    WHEN contains(problem_type, 'Link quality') OR list_contains(metrics, 'errors') THEN 'Link quality issue'
    WHEN list_contains(metrics, 'unknown_protocol') THEN 'Unknown protocol / scan'
    WHEN contains(problem_type, 'Packet surge') THEN 'Small packet scan or connection surge'
    WHEN contains(problem_type, 'Traffic surge') THEN 'Business traffic growth or large transfer'
    ELSE 'General network anomaly' END"""
_TYPED = f"""{_BY_TYPE}, k AS (SELECT *, {_CAND} AS candidate FROM (SELECT bt.*, g.metrics FROM bt JOIN g USING (bucket))),
c AS (SELECT *, least(100, severity_score + 3 * CASE candidate WHEN 'Queue congestion / buffer pressure' THEN 4 WHEN 'General network anomaly' THEN 1 ELSE 3 END + 4 * affected_port_count) AS score FROM k)"""


@query(f"WITH {RAW_SQL}, {_TYPED} SELECT problem_type, candidate, count(*) AS n, max(score)::INT AS max_score FROM c GROUP BY ALL")
def rca_by_type(spark, d):
    return _by_type(spark, d).groupBy("problem_type", F.col("root_cause_candidate").alias("candidate")).agg(F.count(F.lit(1)).alias("n"), F.max("root_cause_score").alias("max_score"))


@query(
    f"WITH {RAW_SQL}, {_TYPED}, h AS (SELECT *, 'Cause of: ' || problem_type || ' on ports ' || affected_ports AS h FROM c) "
    "SELECT bucket, problem_type AS diagnosis, CASE WHEN length(h) > 60 THEN left(h, 60) || '...' ELSE h END AS hypothesis, 'Medium' AS hypothesis_confidence, 'Inspect the ports' AS action, score >= 85 AS escalate FROM h"
)
def diagnosis_parse(spark, d):
    text = rca.mock_diagnosis(F.col("problem_type"), F.col("evidence"), F.col("root_cause_score") >= 85, F.col("affected_ports"))
    parsed = rca.parse_diagnosis(F.col("text"))
    df = _by_type(spark, d).select("bucket", text.alias("text")).select("bucket", *(c.alias(n) for n, c in parsed.items()))
    return df.select("bucket", "diagnosis", "hypothesis", "hypothesis_confidence", "action", "escalate")


_PROMPT = "'problem: ' || problem_type || chr(10) || 'ports: ' || affected_ports || chr(10) || 'metrics: ' || evidence_metrics || chr(10) || 'severity: ' || severity_score"


def _prompt():
    return rca.prompt({"problem": F.col("problem_type"), "ports": F.col("affected_ports"), "metrics": F.col("evidence_metrics"), "severity": F.col("severity_score")})


@query(f"WITH {RAW_SQL}, {_BY_TYPE} SELECT bucket, {_PROMPT} AS prompt FROM bt")
def diagnosis_prompt(spark, d):
    return alerts.reduce_alerts(_raw(spark, d), mode="intended").select("bucket", _prompt().alias("prompt"))


@query(f"WITH {RAW_SQL}, {_BY_TYPE} SELECT bucket, 'seen ' || length({_PROMPT}) AS diagnosis FROM bt ORDER BY severity_score DESC, bucket LIMIT 10")
def diagnosis_by_model(spark, d):
    """The worst ten events go to a model; here one that counts the characters of its prompt."""
    worst = alerts.reduce_alerts(_raw(spark, d), mode="intended").orderBy(F.col("severity_score").desc(), "bucket").limit(10)
    answers = rca.diagnose(worst, "bucket", _prompt(), lambda text: json.dumps({"problem_type": f"seen {len(text)}"}))
    return answers.select("bucket", rca.parse_diagnosis(F.col("answer"))["diagnosis"].alias("diagnosis"))


@query(f"WITH {EV_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us DESC, event_id DESC) AS rn FROM ev), m AS (SELECT entity, round(avg(value) / 1e6, 9) AS mean_mb FROM k WHERE rn <= 10 GROUP BY entity) SELECT entity, mean_mb, mean_mb > 0.00005 AS above, (SELECT count(*) FROM m o WHERE o.entity <> m.entity AND o.mean_mb > 0.00005) AS others_above FROM m")
def related_devices(spark, d):
    """Whether the last rows of other devices are high as well."""
    return rca.related_devices(ev_series(spark, d), "entity", "value", 0.00005)


@query(f"WITH {EV_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us DESC, event_id DESC) AS rn FROM ev) SELECT entity, count(*) AS window_rows, round(avg(value) / 1e6, 9) AS value_avg_mb, round(max(value) / 1e6, 9) AS value_max_mb FROM k WHERE rn <= 10 GROUP BY entity")
def recent_metrics(spark, d):
    return rca.recent_metrics(ev_series(spark, d), "entity", ["value"])


@query(
    f"""WITH {EV_SQL}, {Z_SQL}, {CP_SQL}, {HOURLY_SQL}, {BAND_SQL}, e AS (SELECT *, f AND NOT coalesce(lag(f) OVER ({BY_TS}), false) AS onset FROM zf), ch AS (SELECT *, coalesce(f, false) AND NOT coalesce(lag(f) OVER ({BY_TS}), false) AS onset FROM cp),
    ons AS (SELECT entity, event_id, us, 'zscore' AS type FROM e WHERE onset UNION ALL SELECT entity, event_id, us, 'changepoint' FROM ch WHERE onset),
    rw AS (SELECT zf.entity, zf.us, zf.event_id, zf.f AS zs, coalesce(cp.f, false) AS cpf, zf.value > 150 AS asym FROM zf JOIN cp ON zf.entity = cp.entity AND zf.event_id = cp.event_id), one AS (SELECT entity, us, arg_min(zs, event_id) AS zs, arg_min(cpf, event_id) AS cpf, arg_min(asym, event_id) AS asym FROM rw GROUP BY entity, us)
    SELECT ons.entity, ons.event_id, ons.us, type, concat_ws(',', CASE WHEN asym THEN 'asymmetry' END, CASE WHEN cpf AND type <> 'changepoint' THEN 'changepoint' END, CASE WHEN zs AND type <> 'zscore' THEN 'zscore' END) AS signals, coalesce(o.out_of_band, false) AS forecast_breach
    FROM ons LEFT JOIN one ON ons.entity = one.entity AND ons.us = one.us LEFT JOIN o ON ons.entity = o.entity AND o.us = ons.us - ons.us % {HOUR}"""
)
def incident_lookup(spark, d):
    """Onsets with what else the row at their time shows, and the forecast of their hour."""
    ev = ev_series(spark, d)
    rows = detect.ma_divergence(detect.rolling_z(ev, S, "value", threshold=2.0), S, "value")
    rows = rows.select("entity", "us", "event_id", F.col("z_flag").alias("zscore"), F.col("change_flag").alias("changepoint"), (F.col("value") > 150).alias("asymmetry"))
    ahead = hourly_forecast(spark, d).select("entity", "us", F.col("out_of_band").alias("breach"))
    df = rca.at_their_time(detect.onsets(ev, S, "value", threshold=2.0), rows, ahead, "entity", HOUR)
    return df.select("entity", "event_id", "us", "type", F.array_join("signals", ",").alias("signals"), "forecast_breach")


@query(
    f"""WITH {RAW_SQL}, {_TYPED}, {CAT_SQL}, {LABELLED_SQL}, n AS (SELECT bucket, event_type, count(*) AS n FROM c JOIN lab ON lab.port::VARCHAR = split_part(affected_ports, ',', 1) AND lab.us BETWEEN c.start_us AND c.end_us GROUP BY ALL),
    g2 AS (SELECT bucket, arg_min(event_type, row(-n, event_type)) AS label FROM n GROUP BY bucket), j AS (SELECT problem_type, coalesce(label, 'unknown') AS label FROM c LEFT JOIN g2 USING (bucket)),
    m AS (SELECT label, CASE label
      WHEN 'traffic_surge' THEN regexp_matches(lower(problem_type), 'traffic|surge|激增')
      WHEN 'error_burst' THEN regexp_matches(lower(problem_type), 'error|錯誤|crc|duplex')
      WHEN 'discard_spike' THEN regexp_matches(lower(problem_type), 'discard|queue|丟棄|buffer|congestion')
      WHEN 'traffic_drop' THEN regexp_matches(lower(problem_type), 'drop|下降|link|failure')
      WHEN 'broadcast_storm' THEN regexp_matches(lower(problem_type), 'broadcast|storm|loop|廣播')
      ELSE false END AS hit FROM j)
    SELECT label, count(*) AS n, sum(hit::INT)::BIGINT AS matched, round(avg(hit::INT), 4) AS accuracy FROM m WHERE label <> 'unknown' GROUP BY label"""
)
def diagnosis_accuracy(spark, d):
    """Diagnoses against the label that most rows of the event's own port and time have; unknown labels are left out."""
    events = _by_type(spark, d).select(F.col("bucket").alias("event_id"), "problem_type", "affected_ports", "start_us", "end_us")
    truth = rca.truth_labels(events, labelled_telemetry(spark, d), "event_type").withColumnRenamed("truth", "label")
    df = events.join(truth, "event_id").where("label != 'unknown'")
    hit = rca.label_matches(F.col("problem_type"), F.col("label"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("matched"), r6(F.avg(hit.cast("int")), 4).alias("accuracy"))


@query(
    f"""WITH {EV_SQL}, {Z_SQL}, e AS (SELECT entity, event_id, z, CASE WHEN abs(z) > 4 THEN 'high' ELSE 'medium' END AS severity, value > 200 AS breach FROM zf WHERE f)
    SELECT entity, event_id, severity, CASE WHEN severity = 'high' OR abs(z) > 5 THEN 'HIGH' WHEN breach THEN 'MEDIUM' ELSE 'LOW' END AS risk, severity = 'high' OR abs(z) > 5 OR breach AS escalate,
    CASE WHEN severity = 'high' OR abs(z) > 5 THEN 'needs_approval' WHEN breach THEN 'notify' ELSE 'auto' END AS gate, CASE severity WHEN 'high' THEN 3 ELSE 2 END AS severity_score FROM e"""
)
def incident_summary(spark, d):
    df = detect.rolling_z(ev_series(spark, d), S, "value", threshold=2.0).where("z_flag").withColumn("severity", F.when(F.abs("z") > 4, "high").otherwise("medium"))
    out = rca.incident(F.col("severity"), F.col("z"), F.col("value") > 200)
    score = lookup(F.col("severity"), {"low": 1, "medium": 2, "high": 3, "critical": 4}, 0)
    return df.select("entity", "event_id", "severity", *(c.alias(n) for n, c in out.items()), score.alias("severity_score"))


@query(
    f"""WITH {EV_SQL}, {CAT_SQL}, j AS (SELECT event, kind, value, us < start_us AS pre FROM ev JOIN cat ON entity = port AND us BETWEEN start_us - 12 * {HOUR} AND end_us)
    SELECT event, '{{"metric":"value","rows":' || count(*) || ',"peak":' || max(value)::INT || '}}' AS context FROM j GROUP BY event"""
)
def rca_context_json(spark, d):
    rows = ev_series(spark, d).withColumnRenamed("event_id", "row_id")
    wide = catalog(spark).withColumn("start_us", F.col("start_us") - 12 * HOUR)
    from ..operators.joins import interval_join

    df = interval_join(rows, wide, "entity").groupBy(F.col("event_id").alias("event")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("value")).cast("int").alias("peak"))
    return df.select("event", F.to_json(F.struct(F.lit("value").alias("metric"), "rows", "peak")).alias("context"))


@query(
    f"""WITH {EV_SQL}, f AS (SELECT *, value > 50 AS f FROM ev), s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER w, false) THEN us END AS st FROM f WINDOW w AS (PARTITION BY entity ORDER BY us, event_id)),
    t AS (SELECT *, CASE WHEN f THEN last_value(st IGNORE NULLS) OVER (PARTITION BY entity ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS since_us FROM s)
    SELECT entity, event_id, coalesce(since_us, -1) AS since_us, CASE WHEN NOT f THEN 'inactive' WHEN us - since_us >= 3600000000 THEN 'firing' ELSE 'pending' END AS state FROM t"""
)
def alert_for_state(spark, d):
    return alerts.alert_states(ev_series(spark, d), "entity", F.col("value") > 50, 3600).select("entity", "event_id", F.coalesce("since_us", F.lit(-1)).alias("since_us"), "state")


_BEFORE = "(PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH {EV_SQL}, c AS (SELECT entity, event_id, value, avg(value) OVER {_BEFORE} AS base, count(value) OVER {_BEFORE} AS n, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS m, CASE WHEN count(value) OVER w >= 3 THEN stddev_samp(value) OVER w END AS s FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    z AS (SELECT *, abs((value - m) / (coalesce(s, 1) + 1e-9)) > 2 AS zs, value > 3 * base AS spike, value > 200 AS lev FROM c WHERE n >= 10)
    SELECT entity, event_id, round(base, 6) AS baseline_mean, round(value / (base + 1e-9), 6) AS deviation, concat_ws(',', CASE WHEN zs THEN 'zscore' END, CASE WHEN spike THEN 'spike' END, CASE WHEN lev THEN 'level' END) AS signals,
    (coalesce(zs, false)::INT + spike::INT + lev::INT) AS n_signals FROM z WHERE value > 100"""
)
def incident_context(spark, d):
    """Context of high values: baseline of the 60 rows before, multiple of it, a map of statistics, and the signals that agree."""
    cut, s = W.with_row_halo(detect.rolling_z(ev_series(spark, d), S, "value", threshold=2.0), S, 61)
    v, before = F.col("value"), s.rows(60, -1)
    df = W.own_rows(cut.withColumn("base", W.enough(v, before, 10, F.avg(v).over(before)))).where("base is not null and value > 100")
    df = df.withColumn("signals", rca.concurrent_signals({"zscore": F.col("z_flag"), "spike": v > 3 * F.col("base"), "level": v > 200}))
    df = df.withColumn("metrics", rca.metric_map({"value": {"baseline_mean": F.col("base"), "event_mean": v}}))
    stats = F.element_at("metrics", "value")
    return df.select("entity", "event_id", r6(stats["baseline_mean"]).alias("baseline_mean"), r6(stats["event_mean"] / (stats["baseline_mean"] + 1e-9)).alias("deviation"), F.array_join("signals", ",").alias("signals"), F.size("signals").alias("n_signals"))


@query(f"WITH {EV_SQL}, {Z_SQL} SELECT entity, event_id, us, CASE WHEN abs(z) > 5 THEN 'high' ELSE 'medium' END AS severity FROM zf WHERE f ORDER BY CASE WHEN abs(z) > 5 THEN 0 ELSE 1 END, us, event_id LIMIT 1")
def worst_event(spark, d):
    """The first event by severity, as its key maps it, and time: the one that a person looks at."""
    df = detect.rolling_z(ev_series(spark, d), S, "value", threshold=2.0).where("z_flag").withColumn("severity", F.when(F.abs("z") > 5, "high").otherwise("medium"))
    order = lookup(F.col("severity"), {"critical": 0, "high": 0, "medium": 1, "low": 2}, 9)
    return df.orderBy(order, "us", "event_id").limit(1).select("entity", "event_id", "us", "severity")
