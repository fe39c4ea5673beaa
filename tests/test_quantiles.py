"""Quantiles by selection against numpy."""

import random

import numpy as np
import pytest

from pulsegrid.operators import quantiles


def table(seed, n=1_000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rng.choice(["a", "a", "a", "b", None])
        wide = rng.choice([rng.uniform(-1, 1), 0.0, 7.25, 1e9 * rng.random(), -(10.0 ** rng.uniform(-30, 30))])
        rows.append((g, None if rng.random() < 0.1 else wide, rng.randrange(5)))
    return rows + [("one", 3.5, 1), ("none", None, None)]


SHARES = (0.0, 0.05, 0.5, 0.9, 1.0)


@pytest.mark.parametrize(("bins", "small"), [(4_096, 10_000), (16, 20)])
def test_quantiles_equal_numpy(spark, bins, small, monkeypatch):
    monkeypatch.setattr(quantiles, "KEPT_ROWS", 100_000 if bins > 100 else 3)  # tables between passes on the driver, and written
    rows = table(bins)
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(4)
    wanted = {f"{c}_{int(100 * q)}": (c, q) for c in ("x", "k") for q in SHARES}
    got = {r["g"]: r for r in quantiles.quantile_table(df, ["g"], wanted, bins, small).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        for at, c in ((1, "x"), (2, "k")):
            values = [row[at] for row in rows if row[0] == g and row[at] is not None]
            for q in SHARES:
                assert r[f"{c}_{int(100 * q)}"] == (pytest.approx(np.quantile(values, q), rel=1e-12) if values else None)


def test_whole_table_and_empty_table(spark):
    df = spark.range(1, 1_002).selectExpr("double(id) AS x", "if(id < 3, 0D, 1e308 - id * 1e300) AS y")
    got = quantiles.quantile_table(df, [], {"m": ("x", 0.5), "p": ("x", 0.125), "y": ("y", 0.5)}, 8, 4).collect()
    assert (got[0]["m"], got[0]["p"]) == (501.0, 126.0)
    assert got[0]["y"] == pytest.approx(1e308 - 500 * 1e300)
    empty = quantiles.quantile_table(df.where("false"), [], {"m": ("x", 0.5)}).collect()
    assert [r["m"] for r in empty] == [None]
    assert quantiles.quantile_table(df.where("false"), ["y"], {"m": ("x", 0.5)}).count() == 0


def test_no_percentile_buffers(spark):
    df = spark.range(50).selectExpr("double(id) AS x", "id % 3 AS g")
    plan = quantiles.with_quantiles(df.groupBy("g").count(), df, ["g"], {"m": ("x", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
