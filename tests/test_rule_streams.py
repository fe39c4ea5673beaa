"""Alert rules on a stream: equal to the batch form, and changed by silence."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import promql
from pulsegrid.streaming import live, rules

T0, STEP = 1_704_067_200_000_000, 300_000_000
COUNTERS = ("INOCTETS", "OUTOCTETS", "INUCASTPKTS", "OUTUCASTPKTS", "INERRORS", "OUTERRORS", "INDISCARDS", "OUTDISCARDS", "INBROADCASTPKTS", "OUTBROADCASTPKTS")


def wide(spark, traffic, ports=(1,)):
    """Rows of five minutes; a gap where traffic is None."""
    rows = [(p, T0 + i * STEP, *([float(x)] + [0.0] * (len(COUNTERS) - 1))) for p in ports for i, x in enumerate(traffic) if x is not None]
    df = spark.createDataFrame(rows, "port long, us long, " + ", ".join(f"{c} double" for c in COUNTERS))
    return df.withColumn("ts", F.timestamp_micros("us"))


def streamed(spark, df, files, stale):
    with rules.timers(spark):
        stream = live.with_event_time(live.replay(spark, df, ["us", "port"], files), late="0 seconds")
        return live.drain(rules.rule_stream(stream, stale)).collect()


TRAFFIC = [10 + i % 3 for i in range(14)] + [900] + [900] + [11] * 12 + [5000] + [None] * 4 + [12] * 3


@pytest.mark.parametrize("files", [1, 4])
def test_samples_equal_the_batch_form_and_silence_changes_the_state(spark, files):
    df = wide(spark, TRAFFIC, (1, 2))
    told = streamed(spark, df, files, 300.0)
    batch = promql.rule_alerts(promql.record(df)).collect()
    assert {(r["alert"], r["port"], r["us"]) for r in told if r["cause"] == "sample"} == {(r["alert"], r["port"], r["us"]) for r in batch}
    flags = {(r["alert"], r["port"], r["us"]): r["state"] != "inactive" for r in batch}
    assert all((r["state"] != "inactive") == flags[r["alert"], r["port"], r["us"]] for r in told if r["cause"] == "sample")
    surge = sorted((r["us"] - T0, r["state"], r["cause"]) for r in told if r["alert"] == "TrafficSurge" and r["port"] == 1 and (r["state"] != "inactive" or r["cause"] != "sample"))
    first, last = 14 * STEP, 28 * STEP
    # it fires a minute after it began, without a row; after five minutes of silence the last one is stale
    assert (first, "pending", "sample") in surge and (first + 60_000_000, "firing", "timer") in surge
    assert surge[-3:] == [(last, "pending", "sample"), (last + 60_000_000, "firing", "timer"), (last + 300_000_000, "inactive", "stale")]


def test_without_staleness_all_states_are_those_of_the_batch_form(spark):
    df = wide(spark, TRAFFIC, (1,))
    told = {(r["alert"], r["us"]): (r["state"], r["since_us"]) for r in streamed(spark, df, 3, 1e9) if r["cause"] == "sample"}
    assert told == {(r["alert"], r["us"]): (r["state"], r["since_us"]) for r in promql.rule_alerts(promql.record(df)).collect()}
