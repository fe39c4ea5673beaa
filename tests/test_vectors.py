"""Vector matching of narrow series, and rate() as the server computes it."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import promql

SECOND = 1_000_000


def vector(spark, rows):
    return spark.createDataFrame(rows, "labels map<string,string>, us long, value double")


def got(df):
    return sorted((tuple(sorted(r["labels"].items())), r["us"], r["value"]) for r in df.collect())


def test_one_to_one_by_all_labels_and_by_some(spark):
    a = vector(spark, [({"port": "1", "dir": "in"}, 0, 6.0), ({"port": "2", "dir": "in"}, 0, 8.0), ({"port": "3", "dir": "in"}, 0, 1.0)])
    b = vector(spark, [({"dir": "in", "port": "1"}, 0, 2.0), ({"port": "2", "dir": "out"}, 0, 4.0), ({"port": "1", "dir": "in"}, 5, 9.0)])
    assert got(promql.match_vectors(a, "-", b)) == [((("dir", "in"), ("port", "1")), 0, 4.0)]
    assert got(promql.match_vectors(a, "/", b, on=["port"])) == [((("port", "1"),), 0, 3.0), ((("port", "2"),), 0, 2.0)]
    assert got(promql.match_vectors(a, "/", b, ignoring=["dir"])) == [((("port", "1"),), 0, 3.0), ((("port", "2"),), 0, 2.0)]


def test_many_to_one_keeps_labels_and_takes_some_over(spark):
    many = vector(spark, [({"port": "1", "kind": "e"}, 0, 6.0), ({"port": "1", "kind": "d"}, 0, 3.0), ({"port": "9", "kind": "d"}, 0, 3.0)])
    one = vector(spark, [({"port": "1", "site": "x"}, 0, 3.0), ({"port": "2", "site": "y"}, 0, 0.0)])
    want = [((("kind", "d"), ("port", "1"), ("site", "x")), 0, 1.0), ((("kind", "e"), ("port", "1"), ("site", "x")), 0, 2.0)]
    assert got(promql.match_vectors(many, "/", one, on=["port"], many="left", include=["site"])) == want
    flipped = got(promql.match_vectors(one, "*", many, on=["port"], many="right"))
    assert flipped == [((("kind", "d"), ("port", "1")), 0, 9.0), ((("kind", "e"), ("port", "1")), 0, 18.0)]


def test_many_to_many_is_an_error(spark):
    many = vector(spark, [({"port": "1", "kind": "e"}, 0, 6.0), ({"port": "1", "kind": "d"}, 0, 3.0)])
    with pytest.raises(Exception, match="several series"):
        promql.match_vectors(many, "+", many, on=["port"]).collect()
    with pytest.raises(Exception, match="several series"):
        promql.match_vectors(many, "+", many, on=["port"], many="left").collect()
    with pytest.raises(ValueError, match="no vector operation"):
        promql.match_vectors(many, "^", many)


def test_a_quotient_by_zero_is_null_and_names_cannot_run_together(spark):
    a = vector(spark, [({"a": "1", "b": "2"}, 0, 6.0)])
    assert got(promql.match_vectors(a, "/", vector(spark, [({"a": "1", "b": "2"}, 0, 0.0)]))) == [((("a", "1"), ("b", "2")), 0, None)]
    assert got(promql.match_vectors(a, "/", vector(spark, [({"a": "1,b=2"}, 0, 1.0)]))) == []


def server_rate(points, t, seconds):
    """The published rule, written as a loop."""
    own = [(u, v) for u, v in points if t - seconds * SECOND < u <= t]
    if len(own) < 2:
        return None
    rise = own[-1][1] - own[0][1] + sum(a for (_, a), (_, b) in zip(own, own[1:], strict=False) if b < a)
    sampled = (own[-1][0] - own[0][0]) / SECOND
    mean = sampled / (len(own) - 1)
    start, end = (own[0][0] - (t - seconds * SECOND)) / SECOND, (t - own[-1][0]) / SECOND
    start = mean / 2 if start >= 1.1 * mean else start
    if rise > 0 and own[0][1] >= 0:
        start = min(start, sampled * own[0][1] / rise)
    end = mean / 2 if end >= 1.1 * mean else end
    return rise * (sampled + start + end) / sampled / seconds


def test_rate_with_resets_gaps_and_zero(spark):
    points = [(15 * i * SECOND, float(v)) for i, v in enumerate([0, 5, 9, 14, 3, 8, 20, 21, 30, 31, 2, 4]) if i not in (7, 8)] + [(400 * SECOND, 50.0), (401 * SECOND, 50.5)]
    df = spark.createDataFrame([("m", {"a": "1"}, u, v, i) for i, (u, v) in enumerate(points)], "metric string, labels map<string,string>, us long, value double, event_id long")
    out = {r["us"]: r["rate"] for r in promql.rate_at(df, 60, 0, 480 * SECOND, 10 * SECOND).collect()}
    want = {t * SECOND: r for t in range(0, 481, 10) if (r := server_rate(points, t * SECOND, 60)) is not None}
    assert out == pytest.approx(want)
    assert promql.rate_at(df.where(F.lit(False)), 60, 0, 480 * SECOND, 10 * SECOND).count() == 0
