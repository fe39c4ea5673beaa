"""Helpers shared by the text operators: column picking, checkpoints and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words are hashed this many text bytes at a time, which bounds the numpy temporaries of a task.
SLICE_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name first, whatever other columns (also ones that differ only in case) there are."""
    at = []
    for name in names:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        at.append(same[0])
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(*(F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)))


def pick_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows whose doc_id and key are in kept (id, key), null ids included; of rows that repeat both, the one with the longest text.

    Each task keeps one row of a pair before the shuffle, so that repeats don't gather in one task; the join runs in the
    same partitions, so that texts are shuffled once.
    """
    pair = ("_id", "_none", "_key")
    keys = lambda df, at: dict(zip(pair, (F.coalesce(df["doc_id"], F.lit(0)), df["doc_id"].isNull(), at), strict=True))
    first = F.row_number().over(Window.partitionBy(*pair).orderBy(F.length(docs["text"]).desc_nulls_last(), docs["text"]))
    once = docs.withColumns(keys(docs, key)).withColumn("_row", first).where("_row = 1")
    return once.join(kept.withColumns(keys(kept, kept[kept.columns[1]])).select(*pair), list(pair), "left_semi").drop(*pair, "_row")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session in one process may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pulsegrid-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable (shared, replicated) checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch that a Python worker gets at once while an operator makes its tables.
BATCH_BYTES = 4 << 20


@contextmanager
def sparing(spark: SparkSession):
    """Queries begun in here free their shuffle files when they end, not when the driver's JVM comes to collect garbage, and
    hand Python workers small batches."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Tables:
    """Tables between the steps of an operator, as Parquet in the shared checkpoint folder: they cut the lineage and outlive
    lost executors, and each goes as soon as no later step reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[DataFrame, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with sparing(self.spark):
            df.select("*").write.option("compression", "zstd").parquet(path)  # snappy holds direct buffers outside the heap
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of these tables, which write() gave."""
        for df in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._paths.pop(df))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Shared:
    """A value that goes to every task once, pickled with the code of its classes. Only for values of bounded size."""

    def __init__(self, spark: SparkSession, value: object = None, pickled: bytes | None = None):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value) if pickled is None else bytes(pickled))

    @property
    def value(self):
        return cloudpickle.loads(self._bytes.value)

    def forget(self) -> None:
        """No later task needs the value."""
        self._bytes.unpersist()


# -- vectorised words ---------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: everything but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words: digits, letters (lower-cased) and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER_BASE, _BLOCK = 0x9E3779B97F4A7C15, 1 << 12
_MIX = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_POWER_BASE, _BLOCK)
_BLOCK_BASE = pow(_POWER_BASE, _BLOCK, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts in one array: hash (64 bits), start and end byte of each, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.lowered = LOWER[data]
        inside = is_word[self.lowered]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0], edge[1:] = False, inside
        edge[offsets[:-1]] = False  # a word ends with its text
        starts = np.flatnonzero(inside & ~edge[:-1])
        edge[:-1], edge[-1] = inside, False
        edge[offsets[1:]] = False
        self.starts, self.ends = starts, np.flatnonzero(inside & ~edge[1:]) + 1
        self.offsets = offsets
        self.first = np.searchsorted(starts, offsets)  # of each text's first word; the last entry is the number of words
        self.hashes = np.empty(len(starts), dtype=np.uint64)
        sizes = self.ends - starts
        total, i = np.concatenate([[0], np.cumsum(sizes)]), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE_BYTES, side="right")) - 1)
            part = slice(starts[i], self.ends[j - 1])
            self.hashes[i:j] = self._hash(self.lowered[part][inside[part]], sizes[i:j])
            i = j

    @staticmethod
    def _hash(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of words of these sizes, whose bytes follow one another."""
        at = np.cumsum(sizes) - sizes
        inner = np.arange(len(letters)) - np.repeat(at, sizes)
        most = int(sizes.max())
        if most <= _BLOCK:
            weights = _POWERS[inner]
        else:
            weights = _POWERS[inner % _BLOCK] * _powers(_BLOCK_BASE, most // _BLOCK + 1)[inner // _BLOCK]
        return mix(np.add.reduceat(_TABLE[letters] * weights, at))

    def beginnings(self, which: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes of these words, which are longer; none equals a whole word's hash by design."""
        h = np.full(len(which), n, dtype=np.uint64) * _MIX[3]
        for j in range(n):
            h += _TABLE[self.lowered[self.starts[which] + j]] * _POWERS[j]
        return mix(h)

    def word(self, i: int) -> bytes:
        return self.lowered[self.starts[i] : self.ends[i]].tobytes()


def word_hash(word: bytes) -> int:
    """The hash that Words gives to this word."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(Words(data, np.array([0, len(data)]), np.ones(256, dtype=bool)).hashes[0])


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into (first row, end row, UTF-8 bytes, offsets) of about SLICE_BYTES; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of `size` words; a shorter text has one, its whole sequence."""
    h, out = words.hashes, []
    n = max(0, len(h) - size + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for j in range(size if n else 0):
        runs += h[j : j + n] * (_MIX[j % 5] + np.uint64(2 * (j // 5)))
    runs = mix(runs)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for x in h[a:b]:
                short = mix(short * _MIX[4] + x)
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
