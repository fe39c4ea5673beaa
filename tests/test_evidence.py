"""Numbers over tables, truth by evidence, label summaries, contributions and segments against plain computations."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import windows as W
from pulsegrid.operators import explore, iforest, numbering, rca


def test_numbers_follow_the_order_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.randrange(5), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(5)
    out = numbering.number_rows(df, [F.col("a"), F.col("b").desc(), F.col("i")], "n").collect()
    assert [r["i"] for r in sorted(out, key=lambda r: r["n"])] == [i for _, _, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2]))]
    assert sorted(r["n"] for r in out) == list(range(1, 2_001))
    assert numbering.number_rows(df.where("false"), [F.col("a")], "n").count() == 0
    same = numbering.number_rows(df.withColumn("a", F.lit(1)), [F.col("a")], "n")
    assert sorted(r["n"] for r in same.collect()) == list(range(1, 2_001))


def test_events_are_numbered_before_they_are_ranked(spark):
    rows = [(20, 40, "x", 1), (10, 30, "y", 9), (10, 90, "z", 2), (10, 90, "a", 3)]
    df = spark.createDataFrame(rows, "start_us long, severity_score int, alert_name string, root_cause_score int")
    got = {r["alert_name"]: r["rca_event_id"] for r in rca.number_events(df).collect()}
    assert got == {"a": "RCA-001", "z": "RCA-002", "y": "RCA-003", "x": "RCA-004"}


def test_truth_is_the_label_of_the_events_own_rows(spark):
    events = spark.createDataFrame([(1, "3,4", 0, 100), (2, "4", 0, 100), (3, "9", 0, 100), (4, "3", 500, 600)], "event_id long, affected_ports string, start_us long, end_us long")
    telemetry = spark.createDataFrame([(3, 0, "b"), (3, 50, "a"), (3, 100, "b"), (3, 101, "a"), (3, 102, "a"), (4, 10, "y"), (4, 20, "x")], "port long, us long, event_type string")
    got = {r["event_id"]: r["truth"] for r in rca.truth_labels(events, telemetry, "event_type").collect()}
    assert got == {1: "b", 2: "x", 3: "unknown", 4: "unknown"}


def test_label_summary_and_flags_against_numpy(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["normal", "surge", None]), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, label string, score double")
    flagged = iforest.flagged(df, 0.1)
    limit = np.quantile([r[2] for r in rows], 0.9)
    assert {r["i"] for r in flagged.where("anomaly").collect()} == {i for i, _, s in rows if s > limit}
    for r in iforest.label_summary(flagged, "label").collect():
        own = [s for _, label, s in rows if label == r["label"]]
        assert r["rows"] == len(own) and r["avg_score"] == pytest.approx(statistics.fmean(own))
        assert r["p95_score"] == pytest.approx(np.quantile(own, 0.95)) and r["anomaly_rate"] == pytest.approx(sum(s > limit for s in own) / len(own))


def test_contributions_over_marked_rows_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)) * [1, 5, 0, 2], 6)
    marked = rng.random(300) < 0.1
    df = spark.createDataFrame([(*map(float, row), bool(m)) for row, m in zip(x, marked, strict=True)], "a double, b double, c double, d double, m boolean")
    away = np.abs(x - np.median(x, axis=0))
    mad = np.median(away, axis=0)
    want = (away[marked] / np.where(mad > 0, mad, 1)).mean(axis=0)
    got = {r["feature"]: r["contribution"] for r in iforest.contributions(df, ["a", "b", "c", "d"], F.col("m")).collect()}
    assert got == pytest.approx(dict(zip("abcd", want.tolist(), strict=True)))


def test_segments_against_a_baseline(spark):
    rows = [(p, i, i * 60_000_000, float(10 + i // 10), 0.0) for p in (1, 2) for i in range(40 if p == 1 else 12)]
    df = spark.createDataFrame(rows, "entity long, event_id long, us long, x double, zero double").withColumn("ts", F.timestamp_micros("us"))
    out = explore.segment_multipliers(df, W.Series(), {"x": 0.0, "zero": 0.0}, {"A": (10, 20), "B": (35, 99), "C": (200, 300)}, (0, 10)).collect()
    got = {(r["entity"], r["segment"], r["metric"]): (r["rows"], r["multiplier"]) for r in out}
    assert got == {(1, "A", "x"): (10, 1.1), (1, "B", "x"): (5, 1.3), (1, "A", "zero"): (10, None), (1, "B", "zero"): (5, None), (2, "A", "x"): (2, 1.1), (2, "A", "zero"): (2, None)}
