"""Edge cases of the telemetry operators on hand-made series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions import scans
from pulsegrid.functions import windows as W
from pulsegrid.operators import alerts, detect, forecast, iforest, joins, promql, rca
from pulsegrid.sources import generator, readers, sinks
from pulsegrid.streaming import live

S = W.Series()


def series(spark, values, step_us=300_000_000, entity="a"):
    rows = [(entity, i, i * step_us, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity string, event_id long, us long, value double").withColumn("ts", F.timestamp_micros("us"))


def column(df, name):
    return [r[name] for r in df.orderBy("us", "event_id").collect()]


def test_constant_series_has_no_flags(spark):
    df = detect.robust_z(detect.rolling_z(series(spark, [5] * 100), S, "value"), S, "value")
    assert not any(column(df, "z_flag")) and not any(column(df, "rz_high"))
    assert set(column(df.withColumn("s", W.roll_std(F.col("value"), S, 12, 6)), "s")) == {0.0}


def test_zeros_then_one_flags_once(spark):
    df = detect.robust_z(series(spark, [0] * 100 + [1]), S, "value")
    assert sum(column(df, "rz_high")) == 1


def test_short_series(spark):
    df = series(spark, [1, 2, 3, 4, 5]).withColumn("m", W.roll_mean(F.col("value"), S, 12, 6))
    assert column(df, "m") == [None] * 5


def test_z_is_bounded(spark):
    df = detect.rolling_z(series(spark, [0] * 30 + [1000]), S, "value")
    assert max(abs(z) for z in column(df, "z") if z is not None) <= 19 / 20**0.5 + 1e-6


def test_safe_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (1.0, -1.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_div(F.col("a"), F.col("b"))).collect()] == [0.0, 2.0, 0.0, None]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in odd.select(C.finite_or_zero(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.0]


def test_counter_reset_and_equal_times(spark):
    assert column(scans.counter_rate(series(spark, [10, 20, 5, 9]), S, "value", "r"), "r") == pytest.approx([0, 10 / 300, 0, 4 / 300])
    same = series(spark, [1, 2, 3]).withColumn("us", F.when(F.col("event_id") == 2, 900_000_000).otherwise(0)).withColumn("ts", F.timestamp_micros("us"))
    assert column(scans.counter_rate(same, S, "value", "r"), "r")[1] == pytest.approx(1 / 900)


def test_runs_at_both_ends(spark):
    got = detect.runs(series(spark, [1, 1, 0, 1]), S, F.col("value") == 1).orderBy("run").collect()
    assert [r["rows"] for r in got] == [2, 1]


def test_deadband_needs_all_rows(spark):
    assert not any(column(series(spark, [1, 1, 0, 1, 1]).withColumn("d", W.deadband(F.col("value") == 1, S, 3)), "d"))


def test_cusum_below_mean_stays_zero(spark):
    df = scans.scan(series(spark, [1, 2, 1]), S, {"c": scans.Cusum(F.col("value") - 5)})
    assert column(df, "c") == [0.0, 0.0, 0.0]


def test_interval_ends_are_inside_and_wildcards(spark):
    cat = spark.createDataFrame([("A", "a", 300_000_000, 600_000_000), ("M", "MULTI", 0, 0)], "event_id string, port string, start_us long, end_us long")
    rows = series(spark, [1, 2, 3, 4]).withColumnRenamed("event_id", "row_id")
    assert joins.interval_join(rows, cat, "entity").count() == 2
    assert joins.interval_join(rows, cat, "entity", wildcard=True).count() == 3
    bucketed = joins.interval_join(rows, cat, "entity", wildcard=True, bucket_us=300_000_000)
    assert bucketed.count() == 3


def test_as_of_without_an_earlier_row(spark):
    left = spark.createDataFrame([("a", 5), ("a", 400_000_000)], "entity string, us long")
    right = series(spark, [7, 8]).where("us > 0")
    assert [(r["us"], r["matched"]) for r in joins.as_of(left, right, "entity", "value").collect()] == [(400_000_000, 8.0)]
    assert joins.latest_at(right, 10, "entity").count() == 0


def test_range_window_is_open_on_the_left(spark):
    df = series(spark, range(10)).withColumn("n", F.count("value").over(S.span(1800)))
    assert max(column(df, "n")) == 6


def test_severity_and_taxonomy(spark):
    raw = spark.createDataFrame([(p, 0, m, f"{m}__flag_z_high", 0) for p in range(9) for m in ("broadcast_total", "traffic_total")], "port int, us long, metric string, alert_name string, bucket long")
    assert {r["problem_type"] for r in alerts.reduce_alerts(raw).collect()} == {"General anomaly"}
    one = alerts.reduce_alerts(raw, "intended").collect()
    assert [(r["problem_type"], r["severity_score"]) for r in one] == [("Broadcast storm / L2 loop", 100)]
    assert rca.candidates(alerts.reduce_alerts(raw, "intended")).first()["root_cause_candidate"] == "Broadcast storm / L2 loop"


@pytest.mark.parametrize(
    ("metrics", "ports", "kind", "cause", "evidence"),
    [
        ("broadcast", 2, "Broadcast storm / L2 loop", "Broadcast storm / L2 loop", 3), ("broadcast", 1, "Broadcast anomaly", "Broadcast storm / L2 loop", 3), ("multicast,traffic", 3, "Multicast flooding", "Multicast flooding", 3),
        ("discards,traffic", 1, "Queue congestion", "Queue congestion / buffer pressure", 4), ("discards,errors,traffic", 1, "Queue / buffer pressure", "Queue congestion / buffer pressure", 4), ("errors", 1, "Link quality issue", "Link quality issue", 3),
        ("errors,traffic", 1, "Traffic surge / capacity pressure", "Link quality issue", 3), ("unknown_protocol", 1, "Unknown protocol / scan", "Unknown protocol / scan", 3), ("packets,traffic", 1, "Traffic or packet surge", "General network anomaly", 1),
        ("packets", 1, "Packet surge / possible scan", "Small packet scan or connection surge", 3), ("traffic", 1, "Traffic surge / capacity pressure", "Business traffic growth or large transfer", 3), ("multicast", 1, "Multicast anomaly", "Multicast flooding", 3),
        ("other", 1, "General anomaly", "General network anomaly", 1),
    ],
)
def test_kinds_and_causes(spark, metrics, ports, kind, cause, evidence):
    df = spark.createDataFrame([(metrics, ports, 10, 0, 0)], "evidence_metrics string, affected_port_count int, severity_score int, start_us long, end_us long")
    got = rca.candidates(df.withColumn("problem_type", alerts.problem_type(F.split("evidence_metrics", ","), F.col("affected_port_count")))).first()
    assert (got["problem_type"], got["root_cause_candidate"], got["root_cause_score"]) == (kind, cause, 10 + 3 * evidence + 4 * ports)


def test_models_are_asked_in_tasks_and_tools_answer(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, t string")
    assert {r["k"]: r["answer"] for r in rca.diagnose(df, "k", F.col("t"), str.upper).collect()} == {1: "A", 2: "B", 3: None}
    schemas = {t["name"]: t["input_schema"] for t in rca.IncidentTools.schemas()}
    assert {n: s["required"] for n, s in schemas.items()} == {"get_recent_metrics": ["device"], "check_related_devices": [], "create_incident_summary": ["severity", "root_causes", "actions"]}
    assert schemas["create_incident_summary"]["properties"]["severity"] == {"type": "string", "enum": ["low", "medium", "high", "critical"]}
    assert schemas["get_recent_metrics"]["properties"]["minutes"] == {"type": "integer", "default": 10}
    rows = spark.createDataFrame([(d, i, i, v * 1e6) for d, v in (("a", 1.0), ("b", 3.0), ("c", 5.0)) for i in range(12)], "device string, us long, event_id long, rx double")
    tools = rca.IncidentTools(rows, "device", "c", ["rx"])
    assert tools.call("get_recent_metrics", {"device": "b", "minutes": 4}) == {"device": "b", "window_rows": 4, "rx_avg_mb": 3.0, "rx_max_mb": 3.0}
    assert tools.call("get_recent_metrics", {"device": "z"})["window_rows"] == 0
    assert tools.call("check_related_devices", {"threshold_mb": 2.0})["others_above"] == 1
    assert tools.call("create_incident_summary", {"severity": "low", "root_causes": ["x"], "actions": []})["recorded"] and tools.incidents[0]["escalate"] is False
    assert "error" in tools.call("reboot", {}) and "error" in tools.call("get_recent_metrics", {})


@pytest.mark.parametrize(("rows", "hours"), [(1, 40), (5, 40), (5, 1), (288, 40)])
def test_row_frames_are_whole_in_every_stretch(spark, monkeypatch, rows, hours):
    """Stretches of a few rows give what one window over the entity gives."""
    monkeypatch.setattr(W, "STRETCH_ROWS", 7)
    rng = random.Random(rows)
    values = [(e, i, t, None if rng.random() < 0.1 else float(rng.randrange(50))) for e in ("a", "b", None) for i, t in enumerate(sorted(rng.randrange(hours * 3_600_000_000) for _ in range(60)))]
    df = spark.createDataFrame(values, "entity string, event_id long, us long, value double").withColumn("ts", F.timestamp_micros("us"))
    cut, stretch = W.with_row_halo(df, S, rows)
    most = cut.groupBy(*stretch.by).count().agg(F.max("count")).first()[0]
    assert most <= 4 * 7 + rows and cut.count() <= (2 + rows / 7) * len(values) + len(values)
    got = W.own_rows(cut.withColumn("n", F.count("value").over(stretch.rows(rows))).withColumn("s", F.sum("value").over(stretch.rows(rows))))
    want = df.withColumn("n", F.count("value").over(S.rows(rows))).withColumn("s", F.sum("value").over(S.rows(rows)))
    assert got.count() == len(values) and got.exceptAll(want).count() == 0
    stats = W.roll_order(df, S, {"median": ("value", rows, 1, 0.5), "mad": ("value", rows, 2, "mad"), "p": ("value", rows, 1, 0.9)}).toPandas().set_index(["entity", "event_id"])
    for e in ("a", "b"):
        own = [v for k, _, _, v in values if k == e]
        for i in range(60):
            frame = np.array([v for v in own[max(0, i - rows + 1) : i + 1] if v is not None])
            row = stats.loc[(e, i)]
            assert (np.isnan(row["median"]) if not len(frame) else row["median"] == pytest.approx(np.median(frame)))
            assert (np.isnan(row["mad"]) if len(frame) < 2 else row["mad"] == pytest.approx(np.median(np.abs(frame - np.median(frame)))))
            assert np.isnan(row["p"]) if not len(frame) else row["p"] == pytest.approx(np.quantile(frame, 0.9))


def test_alert_resets(spark):
    df = alerts.alert_states(series(spark, [1, 1, 0, 1, 1, 1], 60_000_000), "entity", F.col("value") == 1, 60)
    assert column(df, "state") == ["pending", "firing", "inactive", "pending", "firing", "firing"]


def test_gap_of_two_hours(spark):
    df = series(spark, [1, 2]).withColumn("us", F.when(F.col("event_id") == 1, 9_000_000_000).otherwise(0))
    from pulsegrid.operators.explore import resample_mean

    got = resample_mean(df, S, "value", 60).orderBy("bucket").collect()
    assert [(r["rows"], r["mean"]) for r in got] == [(1, 1.0), (0, None), (1, 2.0)]


def test_forecast_extrapolation(spark):
    df = forecast.forecast_breach(series(spark, range(40)), S, "value").where("event_id = 39")
    assert df.first()["ahead"] == [40.0, 41.0, 42.0, 43.0, 44.0, 45.0] and df.first()["breach"]


def test_ewma_stays_inside(spark):
    values = column(series(spark, [3, 9, 1, 4]).withColumn("y", W.ewma(F.col("value"), S)), "y")
    assert values == pytest.approx([3, 4.5, 3.625, 3.71875])


def test_forest_isolates_a_far_point(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(300)] + [(999, [90.0, -80.0]), (1000, None)], "id long, x array<double>")
    scored = iforest.score(df, F.col("x"), iforest.fit(df, F.col("x"), ["id"], trees=60)).orderBy(F.col("score").desc_nulls_last()).collect()
    assert scored[0]["id"] == 999 and scored[-1]["score"] is None


def test_readers_and_sinks(spark, tmp_path):
    path = str(tmp_path / "rrd.txt")
    (tmp_path / "rrd.txt").write_text("        in out\n\n100: 1.5e+01 nan\n400: -nan 2\nbad: x\n700: 1\n")
    got = {(r["epoch"], r["name"]): r["value"] for r in readers.rrd_fetch(spark, path).collect()}
    assert got == {(100, "in"): 15.0, (100, "out"): None, (400, "in"): None, (400, "out"): 2.0}
    with pytest.raises(ValueError):
        readers.consolidate(spark.range(1), 60, "MEDIAN")
    (tmp_path / "cat.csv").write_text("event_id,event_type,port_id,start_time,periods_5min,description,end_time\nA,x,MULTI,2026-02-01 10:00,2,d,2026-02-01 10:05:00\n")
    row = readers.catalog_csv(spark, str(tmp_path / "cat.csv")).first()
    assert (row["end_time"] - row["start_time"]).seconds == 300
    (tmp_path / "m.txt").write_text('# HELP a\na{x="1",y="b c"} 3\nb 4\n')
    assert [(r["metric"], r["labels"], r["value"]) for r in readers.exposition(spark, str(tmp_path / "m.txt")).collect()] == [("a", {"x": "1", "y": "b c"}, 3.0), ("b", {}, 4.0)]
    wide = spark.createDataFrame([(1, 2.0, "s")], "us long, v double, s string")
    assert sinks.value_columns(wide.drop("us")) == ["v"]
    both = spark.createDataFrame([], "y_hat_upper double, port_id long, z long, y_hat double")
    assert sinks.value_columns(both) == ["y_hat", "y_hat_upper"] and sinks.value_columns(both.drop("y_hat", "y_hat_upper")) == ["z"]
    with pytest.raises(ValueError):
        sinks.value_columns(wide, ["nope"])
    with pytest.raises(ValueError):
        sinks.value_columns(wide.select("s"))
    with pytest.raises(ValueError):
        sinks.narrow_results(wide.drop("us"), "x", ["s"])


def test_generator_repeats_and_is_plausible(spark):
    a, b = generator.telemetry(spark, days=2), generator.telemetry(spark, days=2).repartition(3)
    assert a.count() == 2 * 288 * 5
    assert a.exceptAll(b).count() == 0
    assert a.where("INOCTETS <= 0 or OUTOCTETS < 0 or INERRORS < 0").count() == 0


def test_matchers_and_rules(spark):
    sm = spark.createDataFrame([("m", {"t": "ab"}, 1, 1.0), ("m", {}, 2, 2.0)], "metric string, labels map<string,string>, us long, value double")
    assert promql.select(sm, "m", ("t", "=~", "a")).count() == 0
    assert promql.select(sm, "m", ("t", "=~", "a.")).count() == 1
    assert promql.select(sm, "m", ("t", "=", "")).count() == 1
    with pytest.raises(ValueError):
        promql.select(sm, "m", ("t", ">", "a"))
    assert {r["type"]: r["count"] for r in promql.rule_catalog(spark).groupBy("type").count().collect()} == {"recording": 19, "alerting": 5}
    recorded = spark.createDataFrame([(1, 300_000_000 * i, 5.0 if i in (3, 4) else 0.0, None, 0.0, -9.0) for i in range(6)], "port long, us long, traffic_zscore double, error_rate_zscore double, discard_rate_zscore double, broadcast_zscore double")
    assert {(r["us"], r["state"]) for r in promql.rule_alerts(recorded, "TrafficSurge").where("state != 'inactive'").collect()} == {(900_000_000, "pending"), (1_200_000_000, "firing")}
    assert promql.rule_alerts(recorded).where("state != 'inactive' and alert != 'TrafficSurge'").count() == 0
    assert promql.rule_alerts(recorded, "No.*").count() == 0


def test_replay_clock_wraps(spark):
    df = spark.range(3).select(live.simulated_time(F.lit(0), F.col("id"), 3600, F.lit(3_600_000_000)).alias("t"))
    assert [r["t"] for r in df.collect()] == [0, 3_600_000_000, 3_599_000_000]


def test_poisson_draws(spark):
    for mean in (0.015, 2.0, 180.0):
        u = (F.col("id") + 0.5) / 4000
        got = spark.range(4000).select(generator._poisson(u, mean).alias("n")).agg(F.avg("n").alias("m"), F.var_pop("n").alias("v")).first()
        assert got["m"] == pytest.approx(mean, rel=0.1) and got["v"] == pytest.approx(mean, rel=0.15)


def test_kinds_of_events_change_their_counters(spark):
    kinds = spark.createDataFrame([("J", "unknown_protocol_scan", "1", 0, 10), ("X", "no such kind", "2", 0, 10)], "event_id string, kind string, port string, start_us long, end_us long")
    rows = spark.createDataFrame([("1", 5, 10.0, 1.0), ("2", 5, 10.0, 1.0), ("1", 50, 10.0, 1.0), (None, 5, 10.0, 1.0)], "p string, us long, INUCASTPKTS double, INUNKNOWNPROTOS double")
    got = {(r["p"], r["us"]): (r["event_label"], r["INUCASTPKTS"], r["INUNKNOWNPROTOS"]) for r in generator.inject_kinds(rows, kinds, "p", seed=None).collect()}
    assert got == {("1", 5): ("unknown_protocol_scan", 24.0, 441.0), ("2", 5): ("no such kind", 10.0, 1.0), ("1", 50): ("normal", 10.0, 1.0), (None, 5): ("normal", 10.0, 1.0)}
    drawn = generator.inject_kinds(rows, kinds, "p").where("us = 5 and p = '1'").first()["INUNKNOWNPROTOS"]
    assert 300 < drawn < 600


def test_states_go_on_over_batches_and_late_rows_are_dropped(spark):
    df = series(spark, [0, 9, 9, 9, 0, 9, 9, 9], 60_000_000)
    stream = live.replay(spark, df, ["us", "event_id"], 4)
    got = {r["event_id"]: (r["above"], r["held"]) for r in live.drain(live.online_ewma(stream, "entity", 4.0, 3)).collect()}
    y, above = 0.0, []
    for v in [0, 9, 9, 9, 0, 9, 9, 9]:
        y = 0.25 * v + 0.75 * y
        above.append(y > 4.0)
    assert [got[i][0] for i in range(8)] == above
    assert [got[i][1] for i in range(8)] == [i >= 2 and all(above[i - 2 : i + 1]) for i in range(8)]
    progress: list = []
    live.drain(live.latest(live.replay(spark, df, ["us", "event_id"], 2), "entity", "value"), "complete", progress=progress)
    assert live.health(spark, progress).first()["rows"] == 8
    # the watermark of the first batch (its latest time less an hour) shuts out a row of a later batch that is older
    hours = [0, 10, 11, 1, 30]
    late = spark.createDataFrame([(i, h * 3_600_000_000) for i, h in enumerate(hours)], "event_id long, us long").withColumn("ts", F.timestamp_micros("us")).withColumn("entity", F.lit("a")).withColumn("value", F.lit(1.0))
    stream = live.with_event_time(live.replay(spark, late, ["event_id"], 5))
    windows = {r["start_us"] // 3_600_000_000 for r in live.drain(live.tumbling(stream, "entity", "value", "1 hour")).collect()}
    assert 1 not in windows and {0, 10, 11} <= windows
