"""Frames in time against plain loops, on dense rows, equal times, gaps and missing values."""

import math
import random
import statistics
import time

import numpy as np
import pytest

from pulsegrid.functions import windows as W
from pulsegrid.operators import promql
from pulsegrid.plans import registry

SPAN = 7200


def rows_of(seed, n=600):
    """Rows of two series: bursts, equal times, gaps of up to two days, missing values."""
    rng, out, us = random.Random(seed), [], 1_700_000_000_000_000
    for i in range(n):
        us += rng.choice([0, 0, 1_000_000, 30_000_000, 600_000_000, SPAN * 1_000_000, rng.choice([1, 172_800]) * 1_000_000])
        out.append((rng.choice("ab"), i, us, None if rng.random() < 0.1 else rng.randrange(0, 10_000) / 100))
    return out


def frame_of(rows, row, seconds=SPAN):
    return [r for r in rows if r[0] == row[0] and row[2] - seconds * 1_000_000 < r[2] <= row[2]]


def samples_of(spark, rows):
    df = spark.createDataFrame(rows, "metric string, event_id long, us long, value double").repartition(3)
    return df.selectExpr("metric", "map('host', 'h') AS labels", "event_id", "us", "value")


def near(a, b):
    return (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_work_of_a_frame_does_not_grow_with_its_rows():
    """Half a million rows of one frame: row by row that would be 10^11 steps."""
    n = 500_000
    frames, x = W.Frames(np.arange(n, dtype=np.int64), 1.0), np.arange(n, dtype=float) % 97
    start = time.monotonic()
    count, mean, variance = frames.moments(x)
    assert time.monotonic() - start < 20
    assert count[-1] == n and mean[-1] == pytest.approx(x.mean(), rel=1e-12) and variance[-1] == pytest.approx(x.var(), rel=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_predict_linear_equals_a_loop(spark, seed):
    rows = rows_of(seed)
    df = promql.predict_linear(samples_of(spark, rows), SPAN, 600, keep=["event_id"])
    got = {r["event_id"]: (r["count_over_time"], r["predicted"]) for r in df.collect()}
    assert set(got) == {r[1] for r in rows}
    for row in rows:
        frame = frame_of(rows, row)
        x, known = [(r[2] - row[2]) / 1e6 for r in frame], [((r[2] - row[2]) / 1e6, r[3]) for r in frame if r[3] is not None]
        want = None
        if len(set(x)) > 1 and known:
            mx, my = statistics.fmean(a for a, _ in known), statistics.fmean(b for _, b in known)
            slope = math.fsum((a - mx) * (b - my) for a, b in known) / len(known) / statistics.pvariance(x)
            want = my + slope * (600 - statistics.fmean(x))
        n, predicted = got[row[1]]
        assert n == len(frame) and (near(predicted, want) if want is None else predicted == pytest.approx(want, rel=1e-6, abs=1e-6))


@pytest.mark.parametrize("seed", [3, 4])
def test_frames_equal_loops(spark, seed):
    rows = rows_of(seed)
    df = samples_of(spark, rows).drop("labels")

    def make(frames, column):
        x = column("value")
        n, mean, variance = frames.moments(x)
        return {"n": n, "m": mean, "v": variance, "lo": frames.fold(x, np.fmin), "hi": frames.fold(x, np.fmax), "q": frames.quantile(x, 0.95), "t": frames.total(x).astype(float)}

    s = W.Series(("metric",), ("us", "event_id"))
    got = {r["event_id"]: r for r in W.range_frames(df, s, SPAN, "n long, m double, v double, lo double, hi double, q double, t double", make).collect()}
    for row in rows:
        x = [r[3] for r in frame_of(rows, row) if r[3] is not None]
        want = {"n": len(x), "m": statistics.fmean(x), "v": statistics.pvariance(x), "lo": min(x), "hi": max(x), "q": float(np.quantile(x, 0.95)), "t": math.fsum(x)} if x else {"n": 0, "t": 0.0, **dict.fromkeys(["m", "lo", "hi", "q"])}
        assert all(near(got[row[1]][k], v) for k, v in want.items()), (row, got[row[1]], want)


def test_over_time_equals_a_loop(spark):
    rows = rows_of(5)
    df = promql.over_time(samples_of(spark, rows), SPAN)
    assert df.columns == ["metric", "labels", "event_id", "us", "value", "series", "avg_over_time", "stddev_over_time", "count_over_time"]
    got = {r["event_id"]: r for r in df.collect()}
    for row in rows:
        x, r = [r[3] for r in frame_of(rows, row) if r[3] is not None], got[row[1]]
        assert r["count_over_time"] == len(x) and r["labels"] == {"host": "h"}
        assert near(r["avg_over_time"], statistics.fmean(x) if x else None) and near(r["stddev_over_time"], statistics.pstdev(x) if x else None)


def test_rate_equals_a_loop(spark):
    rows = [(m, i, us, 50.0 if v is None else v) for m, i, us, v in rows_of(6)]
    got = {r["event_id"]: r["rate"] for r in promql.rate(samples_of(spark, rows), SPAN, keep=["event_id"]).collect()}
    for row in rows:
        own = frame_of(rows, row)
        rise = math.fsum(b[3] if b[3] < a[3] else b[3] - a[3] for a, b in zip(own, own[1:]))
        took = (row[2] - own[0][2]) / 1e6
        assert near(got[row[1]], rise / took if took > 0 else None)
    assert len(got) == len(rows)


def test_rate_without_a_known_step_is_null(spark):
    rows = [("a", 1, 0, 5.0), ("a", 2, 1_000_000, None), ("a", 3, 2_000_000, 7.0), ("a", 4, 3_000_000, 9.0)]
    got = promql.rate(samples_of(spark, rows), SPAN).orderBy("event_id").collect()
    assert [r["rate"] for r in got] == [None, None, None, pytest.approx(2 / 3)]


def test_rows_without_a_time_stay(spark):
    rows = [("a", 1, None, 1.0), ("a", 2, None, 3.0), ("a", 3, 5, 9.0)]
    got = promql.predict_linear(samples_of(spark, rows), SPAN, 600).orderBy("event_id").collect()
    assert [(r["event_id"], r["count_over_time"], r["predicted"]) for r in got] == [(1, 2, None), (2, 2, None), (3, 1, None)]


@pytest.mark.parametrize("name", ["pq_predict_linear", "range_window_2h", "pq_avg_over_time", "pq_rate"])
def test_dense_queries_run_no_window_row_by_row(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window [" not in plan
