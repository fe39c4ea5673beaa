"""Recording and alert rules on a stream, as two stateful operators one after the other.

The first keeps an hour of each port's recorded series and judges every row by every rule. The second holds each alert's
condition: it is pending, then firing once it has held long enough, and inactive when it ends or when its series goes
silent. Those two changes come with time and not with a row, so timers in event time make them; a row that arrives later
than such a moment makes the same changes first, so that what is told doesn't depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.promql import ALERT_RULES, HOURLY_RULES, RECORDING_RULES, RULE_SECONDS

#: A series without a row for so long is stale.
STALE_SECONDS = 300
_JUDGED = "alert string, anomaly_type string, severity string, port long, ts timestamp, us long, on boolean, hold long"
_TOLD = "alert string, anomaly_type string, severity string, port long, us long, state string, since_us long, cause string"
_SERIES = [x for x, _ in HOURLY_RULES.values()]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timers(spark: SparkSession):
    """Streams started in here keep their state where timers and lists can be (RocksDB)."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


class Judge(StatefulProcessor):
    """Rows of one port (us, ts and the recorded series) to one row for each alert rule: whether its condition holds.

    The state is what the last hour had; a row between earlier ones is judged by the rows up to it.
    """

    def __init__(self, seconds: int = RULE_SECONDS):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hour = handle.getValueState("hour", "us array<long>, x array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.hour.get() if self.hour.exists() else None
        us, x = (list(held[0]), [list(r) for r in held[1]]) if held else ([], [])
        for row in sorted(rows, key=lambda r: r["us"]):
            at = int(np.searchsorted(us, row["us"], side="right"))
            us.insert(at, row["us"])
            x.insert(at, [float(row[c]) for c in _SERIES])
            first = int(np.searchsorted(us, row["us"] - self.span, side="right"))
            block = np.array(x[first : at + 1])
            mean, std = block.mean(axis=0), block.std(axis=0)
            known = {f"{name}_zscore": round(float((x[at][k] - mean[k]) / max(std[k], least)), 9) for k, (name, (_, least)) in enumerate(HOURLY_RULES.items())}
            for alert, (condition, hold, severity, kind) in ALERT_RULES.items():
                z, sign, limit = condition.split()
                on = known[z] > float(limit) if sign == ">" else known[z] < float(limit)
                yield Row(alert=alert, anomaly_type=kind, severity=severity, port=key[0], ts=row["ts"], us=row["us"], on=on, hold=hold)
        old = int(np.searchsorted(us, us[-1] - self.span, side="right")) if us else 0
        self.hour.update((us[old:], x[old:]))

    def close(self) -> None:
        pass


class Hold(StatefulProcessor):
    """Judged rows of one alert of one port to its states; `cause` is sample (a row), timer (it has held) or stale (silence)."""

    def __init__(self, stale_seconds: float = STALE_SECONDS):
        self.stale = int(stale_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "since long, last long, hold long, state string, kind string, severity string, timer long")

    def _told(self, key, s: dict, us: int, cause: str) -> Row:
        return Row(alert=key[0], anomaly_type=s["kind"], severity=s["severity"], port=key[1], us=us, state=s["state"], since_us=s["since"] if s["since"] >= 0 else None, cause=cause)

    def _until(self, key, s: dict, us: int) -> Iterator[Row]:
        """What changes by itself up to this time: pending to firing, then whatever is left to inactive."""
        silent = s["last"] + self.stale
        if s["state"] == "pending" and s["since"] + s["hold"] <= min(us, silent):
            s["state"] = "firing"
            yield self._told(key, s, s["since"] + s["hold"], "timer")
        if s["state"] != "inactive" and silent <= us:
            s["state"], s["since"] = "inactive", -1
            yield self._told(key, s, silent, "stale")

    def _set_timer(self, s: dict) -> None:
        due = s["last"] + self.stale
        if s["state"] == "pending":
            due = min(due, s["since"] + s["hold"])
        timer = -(-due // 1_000) if s["state"] != "inactive" else -1
        if s["timer"] != timer:
            if s["timer"] >= 0 and s["timer"] in self.waiting:
                self.handle.deleteTimer(s["timer"])
            if timer >= 0:
                self.handle.registerTimer(timer)
            s["timer"] = timer

    def _load(self) -> dict | None:
        self.waiting = set(self.handle.listTimers())
        names = ("since", "last", "hold", "state", "kind", "severity", "timer")
        return dict(zip(names, self.held.get(), strict=True)) if self.held.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self._load() or {"since": -1, "last": -1, "hold": 0, "state": "inactive", "kind": "", "severity": "", "timer": -1}
        for row in sorted(rows, key=lambda r: r["us"]):
            if s["state"] != "inactive":
                # at the row's own time the row decides
                yield from self._until(key, s, row["us"] - 1)
            s |= {"hold": int(row["hold"]) * 1_000_000, "kind": row["anomaly_type"], "severity": row["severity"], "last": row["us"]}
            if row["on"]:
                s["since"] = row["us"] if s["since"] < 0 else s["since"]
                s["state"] = "firing" if row["us"] - s["since"] >= s["hold"] else "pending"
            else:
                s["since"], s["state"] = -1, "inactive"
            yield self._told(key, s, row["us"], "sample")
        self._set_timer(s)
        self.held.update(tuple(s.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load()
        if s is None:
            return
        ended = expiredTimerInfo.getExpiryTimeInMs()
        self.waiting.discard(ended)
        yield from self._until(key, s, ended * 1_000)
        if s["timer"] == ended:
            s["timer"] = -1
        self._set_timer(s)
        self.held.update(tuple(s.values()))

    def close(self) -> None:
        pass


def rule_stream(wide: DataFrame, stale_seconds: float = STALE_SECONDS) -> DataFrame:
    """The states of every alert rule over a stream of wide rows (port, us, ts with a watermark, counters): one row for each
    alert and input row, and one for each change that comes with time alone. Start it within timers()."""
    recorded = wide
    for name, expression in RECORDING_RULES.items():
        recorded = recorded.withColumn(name, F.expr(expression))
    rows = recorded.select(F.col("port").cast("long").alias("port"), "us", "ts", *(F.col(c).cast("double").alias(c) for c in _SERIES))
    judged = rows.groupBy("port").transformWithState(Judge(), _JUDGED, "Append", "EventTime", eventTimeColumnName="ts")
    return judged.groupBy("alert", "port").transformWithState(Hold(stale_seconds), _TOLD, "Append", "EventTime")
