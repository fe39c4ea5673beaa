"""Toxicity by cumulative-link ordinal regression.

Severity grades are ordered; one weight vector over sparse word features and a rising row of thresholds give
P(grade > k) = sigmoid(w.x - threshold_k). Every threshold shares the weights. The result is the expected severity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, Shared, Words, checkpoint, pick, table, text_slices

#: The training sample: so many labelled documents of each grade.
DOCS_PER_GRADE = 2_500
#: Features that the model may use: those that tell toxic documents from others best, seen in MIN_DOCS or more of the sample.
FEATURES, MIN_DOCS = 1_500, 5
#: Both sides weigh the same in training, so that a document is marked where toxic is the likelier of the two.
TOXIC_AT = 0.5


#: Bytes of the word beginnings that are features beside whole words; they carry what inflected or joined words share.
BEGINNINGS = (4, 6, 7, 8)
TWICE = np.uint64(0x5851F42D4C957F2D)


def raw_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and of every word's beginnings, as often as they occur."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    texts, hashes = [text], [words.hashes]
    sizes = words.ends - words.starts
    for k in BEGINNINGS:
        long = np.flatnonzero(sizes > k)
        if len(long):
            texts.append(text[long])
            hashes.append(words.beginnings(long, k))
    return np.concatenate(texts), np.concatenate(hashes)


def distinct_features(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once, and once more, under another hash, if the text has it twice or more."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    again = at[np.diff(np.r_[at, len(h)]) > 1]
    return np.concatenate([text[at], text[again]]), np.concatenate([h[at], h[again] ^ TWICE])


class OrdinalModel:
    def __init__(self, words: np.ndarray, n_grades: int):
        order = np.argsort(words)
        self.words = words[order]
        self.weights = np.zeros(len(words))
        self.thresholds = np.arange(n_grades - 1, dtype=float)

    def train(self, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, l1: float = 0.06, steps: int = 600, rate: float = 0.05) -> None:
        """Proximal Adam on the cumulative-link likelihood, clean and toxic documents weighing the same in all.

        The L1 share, which falls with the sample's size as chance correlations do, drives weights of chance words to 0.
        """
        l1 *= np.sqrt(np.log(len(self.weights) + 1) / len(x))
        for side in (grade == 0, grade > 0):
            weight = np.where(side, weight / max(weight[side].sum(), 1e-12), weight)
        k = len(self.thresholds)
        above = (grade[:, None] > np.arange(k)).astype(float)
        weight = weight / weight.sum()
        base = np.clip((above * weight[:, None]).sum(axis=0), 1e-3, 1 - 1e-3)
        first, gaps = -np.log(base[0] / (1 - base[0])), np.log(np.maximum(1e-2, np.diff(np.log((1 - base) / base))))
        parameters = np.concatenate([self.weights, [first], gaps])
        n = len(self.weights)
        m, v = np.zeros_like(parameters), np.zeros_like(parameters)
        for step in range(1, steps + 1):
            thresholds = parameters[n] + np.concatenate([[0], np.cumsum(np.exp(parameters[n + 1 :]))])
            # P(grade = j) = P(> j - 1) - P(> j)
            tail = 1 / (1 + np.exp(-np.clip((x @ parameters[:n])[:, None] - thresholds, -40, 40)))
            edges = np.concatenate([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))], axis=1)
            rows = np.arange(len(x))
            p = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-12)
            slope = np.concatenate([np.zeros((len(x), 1)), tail * (1 - tail), np.zeros((len(x), 1))], axis=1)
            d_score = -weight * (slope[rows, grade] - slope[rows, grade + 1]) / p
            d_tail = np.zeros((len(x), k + 2))
            d_tail[rows, grade] += weight * slope[rows, grade] / p
            d_tail[rows, grade + 1] -= weight * slope[rows, grade + 1] / p
            d_threshold = d_tail.sum(axis=0)[1:-1]
            d_gaps = np.cumsum(d_threshold[::-1])[::-1]
            g = np.concatenate([x.T @ d_score, [d_gaps[0]], d_gaps[1:] * np.exp(parameters[n + 1 :])])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            size = rate * (1 - step / (steps + 1)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            parameters = parameters - size * m / (1 - 0.9**step)
            parameters[:n] = np.sign(parameters[:n]) * np.maximum(0, np.abs(parameters[:n]) - l1 * size[:n])
        self.weights = parameters[:n]
        self.thresholds = parameters[n] + np.concatenate([[0], np.cumsum(np.exp(parameters[n + 1 :]))])
        used = self.weights != 0
        self.words, self.weights = self.words[used], self.weights[used]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))


def among(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in a sorted array, and where."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    return hit, at[hit]


def feature_rows(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in known) of the known features that each text holds, without repeats."""
    if not len(known) or not len(words.hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text, h = raw_features(words)
    hit, _ = among(h, np.unique(np.concatenate([known, known ^ TWICE])))  # few are left to sort
    text, h = distinct_features(text[hit], h[hit])
    hit, at = among(h, known)
    return text[hit], at


def graded_sample(docs: DataFrame, labels: DataFrame, docs_per_grade: int) -> DataFrame:
    """grade, share (labelled rows that each sampled one stands for) and features (words) of the sample.

    Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality. Ids are taken by their hash; those whose hash is above twice
    the share that is wanted of their grade are left out before any are ranked, so that few are sent.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    graded = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null and toxic is not null").select("doc_id", grade.alias("grade"))
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))  # three rows at most
    hashed = graded.join(F.broadcast(counts), "grade").withColumn("h", F.xxhash64("doc_id"))
    hashed = hashed.where(F.pmod("h", F.lit(1 << 40)) * F.col("n") < F.lit((2.0 * docs_per_grade + 200) * (1 << 40)))
    best = F.row_number().over(Window.partitionBy("grade").orderBy(F.pmod("h", F.lit(1 << 40)), "doc_id"))
    few = hashed.withColumn("rank", best).where(F.col("rank") <= docs_per_grade)
    few = few.select(F.col("doc_id").alias("id"), "grade", (F.col("n") / F.least("n", F.lit(docs_per_grade))).alias("share"))
    # the sample has a bound, and so what is broadcast has one
    rows = pick(docs, "doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id")).select("grade", "share", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets, ALNUM)
                text, hashes = distinct_features(*raw_features(words))
                order = np.argsort(text, kind="stable")
                own = [np.unique(x).astype(np.int64) for x in np.split(hashes[order], np.searchsorted(text[order], np.arange(1, b - a)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(own, pa.list_(pa.int64()))], ["grade", "share", "words"])

    return rows.mapInArrow(run, "grade int, share double, words array<long>")


def fit(docs: DataFrame, labels: DataFrame, docs_per_grade: int = DOCS_PER_GRADE, features: int = FEATURES) -> OrdinalModel | None:
    """Train on a bounded sample of labelled documents; None if fewer than two grades are labelled."""
    sample = checkpoint(graded_sample(docs, labels, docs_per_grade))
    totals = sample.agg(F.sum((F.col("grade") > 0).cast("double")).alias("bad"), F.count(F.lit(1)).alias("n"), F.max("grade").alias("top"), F.countDistinct("grade").alias("kinds")).first()
    if not totals["n"] or totals["kinds"] < 2:
        return None
    bad, good = max(1.0, totals["bad"] or 0.0), max(1.0, totals["n"] - (totals["bad"] or 0.0))
    counts = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.sum((F.col("grade") > 0).cast("double")).alias("b"), F.count(F.lit(1)).alias("all"))
    lift = F.abs(F.col("b") / bad - (F.col("all") - F.col("b")) / good) / F.sqrt(F.col("all") / (bad + good))
    chosen = [r["word"] for r in counts.where(F.col("all") >= MIN_DOCS).orderBy(lift.desc(), "word").limit(features).collect()]
    if not chosen:
        return None
    known = np.sort(np.array(chosen, dtype=np.int64))
    wanted = Shared(docs.sparkSession, known)

    def only_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = wanted.value
        for batch in batches:
            own = [np.flatnonzero(np.isin(features, np.array(w, dtype=np.int64))) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], ["grade", "share", "words"])

    rows = sorted((r["grade"], r["share"], tuple(r["words"])) for r in sample.mapInArrow(only_known, "grade int, share double, words array<long>").collect())
    x = np.zeros((len(rows), len(known)))
    for i, (_, _, own) in enumerate(rows):
        x[i, list(own)] = 1
    # grades without rows would leave thresholds without evidence
    present = sorted({r[0] for r in rows})
    model = OrdinalModel(known.astype(np.uint64), len(present))
    order = np.argsort(known.astype(np.uint64))
    model.train(x[:, order], np.array([present.index(r[0]) for r in rows]), np.array([r[1] for r in rows]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, docs_per_grade: int = DOCS_PER_GRADE, features: int = FEATURES) -> DataFrame:
    """Expected severity of every whole text: doc_id, severity, p_toxic (grade above 0), toxic (p_toxic of 0.5 or more).

    labels: doc_id, quality, toxic; rows with a null id or toxic are left out, and of a repeated id the worst grade
    counts. A null or empty text has no features and scores by the thresholds alone. Without labels of two grades,
    severity and p_toxic are 0. One row for each input row, null and repeated ids included; other columns are ignored.
    """
    return apply(docs, fit(docs, labels, docs_per_grade, features))


def apply(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """Score documents by a model that fit() gave; see score_toxicity."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                n = b - a
                severity, toxic = np.zeros(n), np.zeros(n)
                if model is not None:
                    text, feature = feature_rows(Words(data, offsets, ALNUM), model.words)
                    tails = model.tails(np.bincount(text, weights=model.weights[feature], minlength=n) if len(text) else np.zeros(n))
                    severity, toxic = tails.sum(axis=1), tails[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(severity), pa.array(toxic), pa.array(toxic >= TOXIC_AT)], ["doc_id", "severity", "p_toxic", "toxic"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
