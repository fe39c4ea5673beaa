"""Importance resampling towards a target corpus, ranked by parallel sorting by regular sampling.

Hashed counts of words and word pairs over all documents and over all target texts give each bucket's gain; a document's
weight is the mean gain of its features, and Gumbel noise from its id makes the highest scores a weighted draw without
replacement. To rank them, each task sorts its own rows into a run; regular samples of all runs give splitters, which are
unique, so that ties and repeats part as well; each range's segments of the runs are merged by one task, and the rows that
the ranges before it hold, counted beforehand, complete its ranks.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, Tables, pick, table

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Rows that a range is meant to have; and the most ranges, so that splitters stay few.
RANGE_ROWS, MAX_RANGES = 1_000_000, 2_048
#: Samples of all runs together are about this many at most; they are sorted by one task.
MAX_SAMPLES = 1_000_000
#: Bytes of a text whose features are counted at once.
SLICE = 1 << 18

#: Words: digits, letters (A-Z lowered before) and every byte of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets of features, number of words) of a text, some thousand words at a time.

    A feature is a word, or two that follow one another with one space between; its bucket is the CRC of its bytes. The CRC
    of a pair goes on from that of its first word.
    """
    raw, crc, last, at = (text or "").encode().translate(_LOWER), zlib.crc32, None, 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            more = re.compile(rb"[^0-9a-z\x80-\xff]").search(raw, end)  # never inside a word
            end = more.start() if more else len(raw)
        words = _WORD.findall(raw[at:end])
        singles = list(map(crc, words))
        before = singles[:-1] if last is None else [last, *singles[:-1]]
        pairs = [crc(b" " + w, c) for w, c in zip(words[1:] if last is None else words, before, strict=True)] if words else []
        if words:
            last = singles[-1]
            yield np.array(singles + pairs, dtype=np.int64) % buckets, len(words)
        at = end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends its counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got, out = pick(texts, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow(), np.zeros(buckets, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed ratio of target to source, floored."""
    k, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: Shared, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = words = total = 0
                for found, more in feature_buckets(text.as_py(), len(gain)):
                    n, words, total = n + len(found), words + more, total + int(gain[found].sum())
                weight = total // n if n else 0
                rows.append((n, words, weight, weight + noise(doc, seed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], ["doc_id", "n_features", "n_words", "weight", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """Each task's rows in order, numbered: _run is the task and _at the place, which makes keys unique."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, me = 0, TaskContext.get().partitionId()
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, me)), pa.array(np.arange(n, n + m))], [*batch.schema.names, "_run", "_at"])
            n += m

    keyed = rows.select("*", (-F.col("score")).alias("_a"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_b"), F.col("doc_id").isNull().cast("long").alias("_c"))
    schema = ", ".join(f"{n} {t}" for n, t in [*keyed.dtypes, ("_run", "long"), ("_at", "long")])
    return keyed.sortWithinPartitions("_a", "_b", "_c").mapInArrow(number, schema)


_KEY = ("_a", "_b", "_c", "_run", "_at")


def _splitters(runs: DataFrame, sizes: DataFrame, n_runs: int, ranges: int) -> list[tuple[int, ...]]:
    """ranges - 1 keys at even places among regular samples of all runs.

    Each run gives as many samples as there are ranges (fewer only where all together would be more than MAX_SAMPLES), at
    even places; so no range gets more than twice its share and one sample's step of each run.
    """
    each = max(1, min(ranges, MAX_SAMPLES // max(1, n_runs)))
    step = sizes.select("_run", F.greatest(F.lit(1), F.floor(F.col("_n") / each)).alias("_step"))
    samples = runs.join(F.broadcast(step) if n_runs <= 100_000 else step, "_run").where(F.col("_at") % F.col("_step") == 0).select(*_KEY)
    n = samples.count()
    place = F.row_number().over(Window.orderBy(*_KEY)) - 1  # of the samples alone
    share = max(1.0, n / ranges)
    wanted = sorted({int(share * k) for k in range(1, ranges)} & set(range(1, n)))
    got = samples.select(*_KEY, place.alias("_place")).where(F.col("_place").isin(wanted)) if wanted else None
    return sorted(tuple(r[k] for k in _KEY) for r in got.collect()) if got is not None else []


def rank_by_score(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add rank: 1 for the highest score, ties to the smaller doc_id (null last), further ties in any order.

    Regular sampling bounds the rows of each range, whatever the keys are; no task sees more than one of them.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession, "ranks")
    runs = tables.write(_sorted_runs(rows))
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    ranges = ranges or min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["rows"] // RANGE_ROWS)))
    splitters = _splitters(runs, sizes, total["runs"], ranges)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in _KEY), strict=True)
            yield batch.append_column("_range", pa.array([bisect_right(splitters, k) for k in keys], pa.int32()))

    schema = ", ".join(f"{n} {t}" for n, t in [*runs.dtypes, ("_range", "int")])
    placed = runs.mapInArrow(divide, schema)
    held = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([held.get(k, 0) for k in range(len(splitters) + 1)])])
    offsets = spark.createDataFrame([(k, int(before[k])) for k in range(len(splitters) + 1)], "_range int, _before long")
    merged = Window.partitionBy("_range").orderBy(*_KEY)
    ranked = placed.repartitionById(len(splitters) + 1, "_range").withColumn("_place", F.row_number().over(merged))
    return ranked.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_place")).drop(*_KEY, "_range", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank among those drawn (null: not drawn).

    Of the rows with at least `least_words` words, floor(percent of them / 100) with the highest scores are drawn, ties to
    the smaller doc_id; a null id comes last and takes its noise from an empty id. Null and empty texts have no features and
    weight 0. Repeated rows each count and are each ranked. An empty target has no counts, which leaves the smoothed source
    alone; an empty table gives no rows. Other columns are ignored.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "resampling")
    gains = Shared(spark, bucket_gains(bucket_counts(docs), bucket_counts(target)))
    scored = tables.write(score(docs, gains, seed))
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    ranked = rank_by_score(scored.where(fit))
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
