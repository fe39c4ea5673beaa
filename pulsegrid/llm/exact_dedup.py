"""Exact dedup by content sort.

Texts without white space are dealt to ranges by sampled splitters and sorted there on disk, so that equal ones are
adjacent wherever they are; a scan compares each text with its neighbour in full. A group of copies may lie across any
number of ranges: only the first and the last group of a range can go on in another one, and those few are joined up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, Tables, checkpoint, pick, table

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Characters of a splitter. Texts with the same beginning are told apart by their digest, so splitters stay this short.
SPLITTER_CHARS = 32

_RUN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_points", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("first_points", T.LongType()),
        T.StructField("run_size", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("at_edge", T.BooleanType()),
        T.StructField("is_first", T.BooleanType()),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted range: each row with its run's first row and size. Holds ids, never more than two batches of texts."""
    run: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the run that is open: ids (with a mask of nulls), code points
    last, digest, place = None, None, 0

    def close(at_edge: bool) -> pa.RecordBatch:
        ids, points = (pa.concat_arrays([x[i] for x in run]) for i in (0, 1))
        n = len(ids)
        same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(n, dtype=np.int64)))
        first = np.zeros(n, dtype=bool)
        first[0] = True
        parts = [ids, points, same(digest, pa.string()), same(ids[0].as_py(), pa.int64()), same(points[0].as_py(), pa.int64()), same(n, pa.int64())]
        return pa.RecordBatch.from_arrays([*parts, same(place, pa.int64()), same(at_edge, pa.bool_()), pa.array(first)], _RUN.names)

    for batch in batches:
        ids, points, digests, texts = (batch.column(i) for i in range(4))
        n = len(ids)
        if not n:
            continue
        starts = [0] if last is None or texts[0].as_py() != last else []
        if n > 1:
            starts += (np.flatnonzero(pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
        bounds = [*starts, n] if starts else [n]
        if bounds[0] > 0:
            run.append((ids.slice(0, bounds[0]), points.slice(0, bounds[0])))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if run:
                out.append(close(at_edge=place == 0))
                place += 1
            run, digest = [(ids.slice(a, b - a), points.slice(a, b - a))], digests[a].as_py()
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        last = texts[n - 1].as_py()
    if run:
        yield close(at_edge=True)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group documents whose texts are equal without white space: doc_id, keep_id, group_size, kept, text_sha256.

    One row for each input row. Of a group the row with the most code points in its original text stays, then the one with
    the smallest doc_id (null last). A null text counts as empty; empty texts and texts of white space alone are one
    group. A repeated row (same id) is one more member, and every row with the kept id says kept. Other columns are
    ignored; an empty table gives no rows.

    Plan: one range shuffle of the normalised texts and a scan; what is shuffled after that is two rows for each range.
    A group of any size is dealt over as many ranges as it needs.
    """
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        F.translate(F.coalesce("text", F.lit("")), SPACE, "").alias("norm"),
    )
    rows = rows.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), "norm")
    beginning = F.substring("norm", 1, SPLITTER_CHARS)
    order = [beginning.asc(), F.col("text_sha256").asc(), F.col("norm").asc(), F.col("n_points").desc(), F.col("doc_id").asc_nulls_last()]
    ranges = rows.repartitionByRange(beginning, F.col("text_sha256"), F.xxhash64("doc_id"))
    runs = ranges.sortWithinPartitions(*order).mapInArrow(_scan, _RUN)
    runs = checkpoint(runs.withColumn("part", F.spark_partition_id()))  # ids and digests alone; both uses below must see the same ranges

    best = lambda key, points: F.min(F.struct((-points).alias("less"), F.col(key).isNull().alias("none"), F.col(key).alias("id")))
    edges = runs.where("at_edge and is_first")  # two rows a range at most: a bound in the number of ranges, whatever the groups
    joined = edges.groupBy("text_sha256").agg(best("first_id", F.col("first_points")).alias("best"), F.sum("run_size").alias("total"))
    joined = joined.select(F.col("text_sha256").alias("edge_sha"), F.col("best.id").alias("edge_id"), "total")
    out = runs.join(F.broadcast(joined), runs.at_edge & (runs.text_sha256 == joined.edge_sha), "left")
    keep = F.when(F.col("total").isNotNull(), F.col("edge_id")).otherwise(F.col("first_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("total", "run_size").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts in one sorted range, and whether the run is the range's first or last one."""
    held, last, place = None, None, 0

    def marked(rows: pa.RecordBatch, at_edge: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(at_edge, pa.bool_())], [*rows.schema.names, "at_edge"])

    for batch in batches:
        if not len(batch):
            continue
        norm = pc.replace_substring_regex(pc.fill_null(batch.column("text"), ""), f"[{SPACE}]", "")
        new = np.ones(len(batch), dtype=bool)
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or norm[0].as_py() != last
        last = norm[len(batch) - 1].as_py()
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        if held is not None:
            yield marked(held, [place == 0])
            place += 1
        closed = batch.take(pa.array(starts[:-1]))
        if len(closed):
            yield marked(closed, [place == 0 and i == 0 for i in range(len(closed))])
            place += len(closed)
        held = batch.take(pa.array(starts[-1:]))
    if held is not None:
        yield marked(held, [True])


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with the columns doc_id, text, lang, source, n_chars.

    It is the one that exact_groups keeps; of rows with the same id and number of code points the first by text, source,
    lang and n_chars. Null ids and ids with several texts are no copies where their texts differ. Null, empty and
    white-space texts are one group. An empty table gives no rows.

    Plan: one range shuffle of the rows, as for exact_groups; the first row of each run stays. Only the first and the last
    run of a range, two rows, can belong to a group that goes on in another one, and those are compared.
    """
    docs, tables = pick(docs, *DOCUMENT_COLUMNS), Tables(docs.sparkSession, "exact-dedup")
    norm = F.translate(F.coalesce("text", F.lit("")), SPACE, "")
    keys = {"_start": F.substring(norm, 1, SPLITTER_CHARS), "_sha": F.sha2(norm, 256), "_points": F.length(F.coalesce("text", F.lit("")))}
    best = [F.col("_points").desc(), F.col("doc_id").asc_nulls_last(), "text", F.col("source").asc_nulls_last(), "lang", "n_chars"]
    rows = docs.withColumns(keys)
    ranges = rows.repartitionByRange("_start", "_sha", F.xxhash64("doc_id")).sortWithinPartitions("_start", "_sha", *best)
    schema = T.StructType([*ranges.schema.fields, T.StructField("at_edge", T.BooleanType())])
    firsts = tables.write(ranges.mapInArrow(_firsts, schema))
    edges = firsts.where("at_edge").withColumn("_rank", F.row_number().over(Window.partitionBy("_sha").orderBy(*best))).where("_rank = 1")
    return firsts.where("not at_edge").select(*DOCUMENT_COLUMNS).union(edges.select(*DOCUMENT_COLUMNS))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
