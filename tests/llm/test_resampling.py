"""Importance resampling against a brute-force version of its contract, and the sort by regular sampling against sorted()."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import resampling

from .test_text_operators import docs, edge_rows, prose


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(rows, target):
    def counts(texts):
        out = [0] * 10_000
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out

    source, wanted = counts(t for _, t in rows), counts(target)
    s_all, t_all = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(source, wanted, strict=True)]
    out, fit = [], []
    for doc, text in rows:
        words, found = features(text)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            fit.append(out[-1])
    for rank, row in enumerate(sorted(fit, key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))[: len(fit) * 25 // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def run(spark, rows, target):
    target = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    return sorted(map(tuple, resampling.resample(docs(spark, rows).repartition(5), target).collect()), key=repr)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(300)] + [(1_000 + i, "A-b " * rng.randint(0, 40)) for i in range(40)]
    target = [prose(rng, 50) for _ in range(5)] + [None, ""]
    assert run(spark, rows + edge_rows(), target) == brute(rows + edge_rows(), target)
    assert run(spark, rows, []) == brute(rows, [])


def test_a_third_of_equal_rows_and_null_ids(spark):
    rng = random.Random(5)
    hot = prose(rng, 30)
    rows = [(7, hot)] * 150 + [(None, hot)] * 50 + [(i, prose(rng, 40)) for i in range(300)]
    got, want = (sorted(r, key=lambda x: (x[3], x[2], x[1], x[0] or -1, x[4] or -1)) for r in (run(spark, rows, ["alpha1 beta2"]), brute(rows, ["alpha1 beta2"])))
    assert got == want


def test_long_texts_in_slices_give_the_same_features(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 500) + " é" + "x" * 5_000 + "文字 y", "", None, "!!", "one"]
    whole = [[sorted(b.tolist()) for b, _ in resampling.feature_buckets(t)] for t in texts]
    monkeypatch.setattr(resampling, "SLICE", 64)
    for text, one in zip(texts, whole, strict=True):
        parts = list(resampling.feature_buckets(text))
        assert sorted(x for b, _ in parts for x in b.tolist()) == [x for b in one for x in b]
        assert sum(n for _, n in parts) == len(features(text)[0])
        assert sum(len(b) for b, _ in parts) == len(features(text)[1])


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_regular_sampling_parts_ties_and_ranks_exactly(spark, ranges):
    rng = random.Random(7)
    keys = [(None if rng.random() < 0.3 else rng.randrange(40), rng.choice([5, 5, 5, rng.randrange(10)])) for _ in range(3_000)]
    df = spark.createDataFrame(keys, "doc_id long, score long").repartition(6)
    out = resampling.rank_by_score(df, ranges)
    got = [(r["score"], r["doc_id"]) for r in out.orderBy("rank").collect()]
    assert got == [(s, i) for i, s in sorted(keys, key=lambda k: (-k[1], math.inf if k[0] is None else k[0]))]
    assert [r["rank"] for r in out.select("rank").orderBy("rank").collect()] == list(range(1, 3_001))
    runs = resampling._sorted_runs(df)
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    splitters = resampling._splitters(runs, sizes, sizes.count(), ranges)
    assert len(splitters) == ranges - 1


def test_empty_tables(spark):
    assert run(spark, [(1, "x")], [])[0][4] is None
    assert resampling.resample(docs(spark, edge_rows()).where("false"), spark.createDataFrame([], "item_id long, text string")).count() == 0
