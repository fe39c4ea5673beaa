"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from pulsegrid.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(records, columns, order):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)

    at = [columns.index(c) for c in order]
    return sorted(tuple(cell(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns, order) == rows(want.fetchall(), want.columns, order)


def test_forest_scores_and_flags(spark):
    scores = registry.QUERIES["iforest_scores"](spark, SF).collect()
    assert all(0 < r["score"] < 1 for r in scores)
    flags = registry.QUERIES["iforest_flags"](spark, SF).collect()
    assert len(flags) == len(scores)
    assert 0 < sum(r["anomaly"] for r in flags) <= math.ceil(0.035 * len(flags))
    assert registry.QUERIES["iforest_scores"](spark, SF).collect() == scores
    assert sum(r["rows"] for r in registry.QUERIES["iforest_label_summary"](spark, SF).collect()) == len(scores)


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
