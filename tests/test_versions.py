"""Tables that batches replace and bring up to date: restarts, repeats and readers in between."""

import pytest

from pulsegrid.streaming import live
from pulsegrid.streaming.versions import LateRows, VersionedTable

SCHEMA = "k string, us long, a double, b long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_readers_see_whole_versions_and_repeats_change_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    assert table.read() is None and table.batch() is None
    table.replace(spark.createDataFrame([("x", 1, 1.0, 1), ("y", 1, 2.0, 1)], SCHEMA), 0)
    seen = table.read()
    table.replace(spark.createDataFrame([("x", 2, 5.0, 2)], SCHEMA), 1)
    assert rows(seen, "k", "a") == [("x", 1.0), ("y", 2.0)]  # a reader keeps its version
    assert rows(table.read(), "k", "a") == [("x", 5.0)]  # y is gone with the reload
    table.replace(spark.createDataFrame([("z", 9, 9.0, 9)], SCHEMA), 1)
    table.replace(spark.createDataFrame([("z", 9, 9.0, 9)], SCHEMA), 0)
    assert rows(table.read(), "k", "a") == [("x", 5.0)] and table.batch() == 1


def test_a_batch_that_dies_before_the_pointer_moves_is_not_seen(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t")
    up = lambda df, n: table.upsert(df, n, ["k"], ["a", "b"], ["us"])
    up(spark.createDataFrame([("x", 1, 1.0, 1), ("y", 1, 2.0, 7)], SCHEMA), 0)
    second = spark.createDataFrame([("x", 2, None, 2), ("x", 3, 4.0, None), ("z", 1, 3.0, None), ("y", 0, 99.0, 99)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(table, "_point", lambda batch: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            up(second, 1)
    assert rows(table.gauges(["k"], ["a", "b"]), "k", "a", "b") == [("x", 1.0, 1), ("y", 2.0, 7)]
    for _ in range(2):  # after the restart, and once more
        up(second, 1)
        # a null keeps the old value, and so does a row that is older
        assert rows(table.gauges(["k"], ["a", "b"]), "k", "a", "b") == [("x", 4.0, 2), ("y", 2.0, 7), ("z", 3.0, None)]


def test_a_stream_that_fails_in_a_batch_goes_on_where_it_was(spark, tmp_path):
    data = spark.createDataFrame([(f"k{i % 3}", i, float(i), i) for i in range(60)], SCHEMA)
    stream = live.replay(spark, data, ["us"], 4)
    table, failed = VersionedTable(spark, f"{tmp_path}/t"), []

    def take(df, n):
        table.upsert(df, n, ["k"], ["a", "b"], ["us"])
        if n == 2 and not failed:
            failed.append(n)
            raise RuntimeError("lost after the pointer moved")

    def start():
        return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/offsets").foreachBatch(take).start()

    with pytest.raises(Exception, match="lost after"):
        start().awaitTermination()
    middle = table.batch()
    start().awaitTermination()
    assert failed and middle == 2 and table.batch() == 3
    assert rows(table.gauges(["k"], ["a", "b"]), "k", "a", "b") == [("k0", 57.0, 57), ("k1", 58.0, 58), ("k2", 59.0, 59)]


def test_late_rows_of_a_batch_that_runs_again(spark, tmp_path):
    late = LateRows(spark, f"{tmp_path}/late", "us", 10_000, 5_000)
    batch = lambda *us: spark.createDataFrame([("x", u, 1.0, 1) for u in us], SCHEMA)
    late.take(batch(1_000, 60_000), 0)
    late.take(batch(9_000, 62_000), 1)  # closes windows to 50,000, and none was closed before
    assert late.read().isEmpty()
    late.take(batch(9_000, 44_000, 55_000, 70_000), 2)
    assert rows(late.read(), "us") == [(9_000,), (44_000,)]
    late.take(batch(9_000, 44_000, 55_000, 70_000), 2)
    late.take(batch(48_000, 58_000, 61_000), 3)  # the batch before had 57,000
    late.take(batch(58_000, 61_000), 4)  # 65,000 now
    assert rows(late.read(), "us") == [(9_000,), (44_000,), (48_000,), (58_000,)]


def test_reports_of_more_than_a_hundred_batches(spark):
    data = spark.createDataFrame([("x", i, float(i), i) for i in range(120)], SCHEMA)
    progress = []
    live.drain(live.replay(spark, data, ["us"], 105).select("k", "us"), progress=progress)
    assert sum(p["rows"] for p in progress) == 120 and len({p["batch"] for p in progress}) >= 101
