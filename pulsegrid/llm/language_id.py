"""Language ID with a byte convolutional network.

Filters of several widths run over the embedded bytes of fixed-length windows; each keeps its maximum, and a softmax over
the maxima gives the language. The network is trained here in numpy on a bounded sample of windows of labelled texts.
A text's prediction averages the log-probabilities of all its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, LOWER, Shared, checkpoint, pick, table, text_slices

WINDOW_BYTES = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: The training sample: so many documents of each language, so many windows of each.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 600, 4
#: The sample on the driver has a bound: with many languages each has fewer documents, one at least, as each also has its row
#: of weights in the network.
MOST_DOCS = 24_000
#: Counts of so many languages go to every task; rows meet more of them by a join.
COUNTED_LANGUAGES = 100_000
UNKNOWN = "und"
#: Windows that go through the network at once, and that are cut at once.
CHUNK, BLOCK = 256, 8_192


class ByteConvNet:
    """Embedding, filters of several widths, maximum over places, ReLU, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.widest = max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0  # padding
        self.filters = rng.normal(0, 1, (self.widest * EMBEDDING, n)).astype(np.float32) / np.sqrt(self.widest * EMBEDDING)
        self.mask = np.zeros_like(self.filters)
        for i, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.zeros(n, dtype=np.float32)
        self.dense = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.dense_bias = np.zeros(len(languages), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.dense, self.dense_bias]

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest * EMBEDDING): the embedded bytes that each place's filters see."""
        embedded = self.embedding[windows]
        n, length, _ = embedded.shape
        places = length - self.widest + 1
        view = np.lib.stride_tricks.as_strided(embedded, (n, places, self.widest * EMBEDDING), (embedded.strides[0], embedded.strides[1], embedded.strides[2]))
        return view

    def forward(self, windows: np.ndarray):
        patches = np.ascontiguousarray(self._patches(windows))
        scores = patches.reshape(-1, patches.shape[2]) @ self.filters
        scores = scores.reshape(patches.shape[0], patches.shape[1], -1)
        return patches, scores

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for a in range(0, len(windows), CHUNK):
            _, scores = self.forward(windows[a : a + CHUNK])
            logits = np.maximum(scores.max(axis=1) + self.bias, 0) @ self.dense + self.dense_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[a : a + CHUNK] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on cross-entropy; the gradient of a maximum goes to the place that attains it."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self._gradients(windows[rows], labels[rows]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        patches, scores = self.forward(windows)
        n = len(windows)
        place = scores.argmax(axis=1)
        peak = np.take_along_axis(scores, place[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(peak, 0)
        logits = hidden @ self.dense + self.dense_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ self.dense.T) * (peak > 0)
        seen = patches[np.arange(n)[:, None], place]  # windows, filters, patch
        d_filters = np.einsum("nfp,nf->pf", seen, back, optimize=True) * self.mask
        d_embedding = np.zeros_like(self.embedding)
        spread = back[:, :, None] * self.filters.T[None]  # windows, filters, patch
        for j in range(self.widest):
            at = windows[np.arange(n)[:, None], place + j]
            np.add.at(d_embedding, at.ravel(), spread[:, :, j * EMBEDDING : (j + 1) * EMBEDDING].reshape(-1, EMBEDDING))
        d_embedding[0] = 0
        return [d_embedding, d_filters, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def window_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, end to end: the text of each, its first byte and its bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW_BYTES)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][text] + (np.arange(len(text)) - first) * WINDOW_BYTES
    return text, start, np.minimum(WINDOW_BYTES, offsets[1:][text] - start)


def window_bytes(data: np.ndarray, start: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The lower-cased bytes of these windows; 0 after a text's end."""
    places = np.arange(WINDOW_BYTES)
    out = LOWER[data[np.minimum(start[:, None] + places, len(data) - 1)]]
    out[places >= used[:, None]] = 0
    return out


def training_sample(labelled: DataFrame, docs_per_language: int, windows_per_doc: int) -> DataFrame:
    """lang and windows of so many documents of each language, taken by a hash of text, from any place of the texts.

    Languages are counted first. Rows whose hash is above twice the share that is wanted stay where they are, so that what
    is sent and ranked is a few times the sample, whatever the number of tasks or a language's share of the rows.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    counts = checkpoint(counts)
    n = max(1, counts.count())
    limit = max(1, min(docs_per_language, MOST_DOCS // n))
    share = (2.0 * limit + 200) / F.col("rows")
    chars, counted = WINDOW_BYTES, counts.withColumnRenamed("lang", "counted")
    rows = labelled.withColumn("h", F.xxhash64("text", "doc_id")).join(F.broadcast(counted) if n <= COUNTED_LANGUAGES else counted, F.col("lang") == F.col("counted"))
    rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
    windows = [F.substring("text", (1 + F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("text") - chars, F.lit(0)) + 1)).cast("int"), F.lit(chars)) for i in range(windows_per_doc)]
    rows = rows.select("lang", "h", F.array_distinct(F.array(*windows)).alias("windows"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy("h", "windows"))
    return rows.withColumn("rank", best).where(F.col("rank") <= limit).drop("rank")


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> ByteConvNet | None:
    """Train on text and lang of (doc_id, text, lang) alone; rows without text or lang are left out. None if there are none.

    The sample has docs_per_language documents of each language, fewer where there are many languages (MOST_DOCS in all, or
    one of each).
    """
    usable = pick(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    rows = training_sample(usable, docs_per_language, windows_per_doc).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    samples = sorted((r["h"], r["lang"], w) for r in rows for w in r["windows"])
    raw = [w.encode()[:WINDOW_BYTES] for _, _, w in samples]
    windows = np.zeros((len(raw), WINDOW_BYTES), dtype=np.uint8)
    for i, w in enumerate(raw):
        windows[i, : len(w)] = LOWER[np.frombuffer(w, dtype=np.uint8)]
    net = ByteConvNet(languages)
    net.train(windows, np.array([languages.index(x) for _, x, _ in samples]))
    return net


def score_texts(net: ByteConvNet | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language (or UNKNOWN) and score of each text; all windows of a text count, by their bytes."""
    langs, scores = [], []
    for a, b, data, offsets in text_slices(texts):
        n = b - a
        letters = np.array([any(map(str.isalpha, t.as_py() or "")) for t in texts.slice(a, n)], dtype=bool)
        if net is None or not len(data):
            langs += [UNKNOWN] * n
            scores.append(np.zeros(n))
            continue
        totals, weight = np.zeros((n, len(net.languages))), np.zeros(n)
        places = window_places(offsets)
        for i in range(0, len(places[0]), BLOCK):  # of a long text too, only so many windows are made at once
            text, start, used = (x[i : i + BLOCK] for x in places)
            np.add.at(totals, text, net.log_probabilities(window_bytes(data, start, used)) * used[:, None])
            np.add.at(weight, text, used)
        mean = totals / np.maximum(weight, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        langs += [net.languages[i] if ok else UNKNOWN for i, ok in zip(p.argmax(axis=1), letters, strict=True)]
        scores.append(np.where(letters, p.max(axis=1), 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, lang_pred, score for every whole text; see identify_languages."""
    shared = Shared(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            langs, scores = score_texts(net, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5. A null id is taken as the text of an empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify_languages(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score.

    Learns from text and lang of documents that aren't held out and have both; predictions see the text alone. A text
    that is null or without a letter is `und` with score 0, and so is every text if nothing is labelled. score is the
    probability of the predicted language, averaged over the windows in logarithms. One row for each input row, null and
    repeated ids included; other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    net = fit(rows.where(~held_out(F.col("doc_id"))), docs_per_language, windows_per_doc)
    out = predict(rows, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The documents, with the columns doc_id, text, lang, source, n_chars, that get a language at min_score or above.

    Texts that are null or without a letter go, whatever min_score is.
    """
    docs = pick(docs, *DOCUMENT_COLUMNS)
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    shared = Shared(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            langs, scores = score_texts(net, batch.column(1))
            yield batch.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
