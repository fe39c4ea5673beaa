"""Scans with a carry against whole-series loops, with one entity in many stretches."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scans
from pulsegrid.functions import windows as W
from pulsegrid.operators import alerts, detect, joins

S = W.Series()


def rows_of(seed, n=400):
    """Two entities (and rows without one), gaps, equal times and runs of every length."""
    rng, out, us = random.Random(seed), [], 0
    on = False
    for i in range(n):
        us += rng.choice([0, 1, 300_000_000, 300_000_000, 7_200_000_000])
        on = on if rng.random() < 0.85 else not on
        out.append((rng.choice(["a", "a", "a", "b", None]), i, us, None if rng.random() < 0.2 else rng.randrange(-10, 11) / 2, None if rng.random() < 0.05 else on))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, event_id long, us long, value double, flag boolean").withColumn("ts", F.timestamp_micros("us")).repartition(3)


def loops(rows):
    """Every scan by a loop over each entity."""
    out = {}
    for entity in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == entity), key=lambda r: (r[2], r[1]))
        total = last = before = before_flag = since = None
        n = c = run = 0
        for k, (_, i, us, v, flag) in enumerate(own):
            if v is not None:
                total, n, last = (total or 0.0) + v, n + 1, v
                c = max(0.0, c + v)
            if flag and not before_flag:
                run, since = run + 1, us
            following = next((r[3] for r in own[k:] if r[3] is not None), None)
            later = next((r[2] for r in own[k:] if r[2] > us), None)
            out[i] = {"sum": total, "n": n, "last": last, "next": following, "before": before, "cusum": c, "run": run, "since": since if flag else None, "later": later}
            before, before_flag = v, flag
    return out


@pytest.mark.parametrize(("stretch", "seed"), [(1, 1), (3, 2), (50, 1), (4_096, 2)])
def test_scans_equal_loops(spark, monkeypatch, stretch, seed):
    monkeypatch.setattr(W, "STRETCH_ROWS", stretch)
    monkeypatch.setattr(scans, "COUNTED_ROWS", 0 if seed == 2 else 100_000)  # without and with a broadcast
    rows, v = rows_of(seed), F.col("value")
    wanted = {
        "sum": scans.RunningSum(v), "n": scans.RunningCount(v), "last": scans.LastKnown(v), "next": scans.NextKnown(v), "before": scans.Before(v),
        "cusum": scans.Cusum(v), "run": scans.RunNumber(F.col("flag")), "since": scans.HeldSince(F.col("flag")), "later": scans.NextTime(),
    }
    got = {r["event_id"]: {k: r[k] for k in wanted} for r in scans.scan(frame(spark, rows), S, wanted).collect()}
    assert got == loops(rows)


def test_no_window_holds_a_whole_entity(spark, monkeypatch):
    monkeypatch.setattr(W, "STRETCH_ROWS", 16)
    rows = [("a", i, i * 60_000_000, float(i % 7), i % 5 > 1) for i in range(2_000)]
    df = frame(spark, rows)
    cut, stretch, n = scans.in_stretches(df, S)
    sizes = [r["count"] for r in cut.groupBy("entity", "_chunk").count().collect()]
    assert len(sizes) > 60 and max(sizes) <= 32 and sum(sizes) == 2_000
    plan = scans.scan(df, S, {"c": scans.Cusum(F.col("value"))})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # windows over rows are partitioned by stretch; the others are over counts and summaries
    assert windows and all("_chunk" in line or "_n" in line for line in windows)


def test_runs_states_and_as_of_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(W, "STRETCH_ROWS", 4)
    rows = [("a", i, i * 60_000_000, float(i), 5 <= i < 70 or i > 90) for i in range(100)]
    df = frame(spark, rows)
    got = sorted((r["start_us"], r["end_us"], r["rows"]) for r in detect.runs(df, S, F.col("flag")).collect())
    assert got == [(5 * 60_000_000, 69 * 60_000_000, 65), (91 * 60_000_000, 99 * 60_000_000, 9)]
    states = {r["event_id"]: r["state"] for r in alerts.alert_states(df, "entity", F.col("flag"), 600).collect()}
    assert [states[i] for i in (4, 5, 14, 15, 69, 70, 91, 99)] == ["inactive", "pending", "pending", "firing", "firing", "inactive", "pending", "pending"]
    left = spark.createDataFrame([("a", -1), ("a", 30), ("a", 59 * 60_000_000 + 1), ("b", 5), (None, 3)], "entity string, us long")
    got = [(r["us"], r["matched"]) for r in joins.as_of(left, df, "entity", "value").orderBy("us").collect()]
    assert got == [(30, 0.0), (59 * 60_000_000 + 1, 59.0)]


@pytest.mark.parametrize("ahead", [0, 9])
def test_frames_that_look_ahead_are_whole(spark, monkeypatch, ahead):
    monkeypatch.setattr(W, "STRETCH_ROWS", 5)
    rng = random.Random(3)
    rows, us = [], 0
    for i in range(300):
        us += rng.choice([0, 1, 60_000_000, 7_200_000_000])
        rows.append(("a", i, us, float(i), True))
    cut, s = W.with_row_halo(frame(spark, rows), S, 4, ahead=ahead)
    w = s.window.rowsBetween(-3, ahead)
    got = {r["event_id"]: r["x"] for r in W.own_rows(cut.withColumn("x", F.sum("value").over(w))).collect()}
    assert got == {i: float(sum(range(max(0, i - 3), min(300, i + ahead + 1)))) for i in range(300)}


def test_empty_series(spark):
    assert scans.scan(frame(spark, []), S, {"c": scans.Cusum(F.col("value"))}).count() == 0


def summed(rows, center, anew=False):
    """CUSUM by a loop over each entity; a missing value leaves the sum, or begins anew."""
    out = {}
    for entity in {r[0] for r in rows}:
        c = 0.0
        for _, i, _, v, *_ in sorted((r for r in rows if r[0] == entity), key=lambda r: (r[2], r[1])):
            c = max(0.0, c + (v - center)) if v is not None else 0.0 if anew else c
            out[i] = c
    return out


@pytest.mark.parametrize(("stretch", "center", "broadcast"), [(3, 60, 0), (16, 60, 100_000), (16, 5, 0), (4_096, 60, 100_000)])
def test_cusum_has_the_bits_of_a_loop(spark, monkeypatch, stretch, center, broadcast):
    """Sums of hundredths meet 300 or miss it by their last bits; a center of 5 never brings the sum back to 0."""
    monkeypatch.setattr(W, "STRETCH_ROWS", stretch)
    monkeypatch.setattr(scans, "COUNTED_ROWS", broadcast)
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", None]), i, i // 3 * 60_000_000, None if rng.random() < 0.02 else round(rng.expovariate(1 / 50), 2), None) for i in range(3_000)]
    df, d = frame(spark, rows), F.col("value") - center
    for anew, step in ((False, d), (True, F.coalesce(d, F.lit(float("-inf"))))):
        got = {r["event_id"]: r["c"] for r in scans.cusum(df, S, step, "c").collect()}
        assert got == summed(rows, center, anew)
    assert scans.cusum(frame(spark, []), S, d, "c").count() == 0


def test_cusum_queries_are_beyond_where_a_loop_is(spark, tmp_path):
    """Six copies of every event, as the sums of one go on in the next: several sums are 300 but for their last bits."""
    from pulsegrid.plans import registry

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    events = events.withColumn("event_id", F.explode(F.array(*(F.col("event_id") + k * 1_000_000 for k in range(6)))))
    events = events.withColumn("value", F.when(F.col("event_id") % 997 != 5, F.round(F.col("value"), 0) + 0.1))
    events.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    rows = [(r["event_type"], r["event_id"], r["ts"], r["value"]) for r in events.collect()]
    want = {i: (round(c, 5), c > 300) for i, c in summed(rows, 60, anew=True).items()}
    for name in ("cusum_series", "stream_cusum"):
        got = {r["event_id"]: (r["cusum"], r["beyond"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want, name


def test_no_scan_reads_the_rest_of_its_stretch_for_every_row(spark):
    """A window up to the end of its partition is read anew for every row."""
    v = F.col("value")
    df = scans.scan(frame(spark, rows_of(5)), S, {"next": scans.NextKnown(v), "later": scans.NextTime()})
    df = scans.interpolate(scans.fill_both(df, S, "value", "filled"), S, "value", "x")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
