"""Whitening of embeddings by spectral divide and conquer.

Tasks gather the exact sums and the covariance of the distinct vectors. Its spectrum is divided on the driver, as the matrix
has one row a dimension: the polar factor of the covariance, shifted to the middle of its spectrum, is +1 on the eigenvectors
above the shift and -1 on those below; half of one plus it is the projector on the upper ones. Both invariant subspaces are
divided again until each is one component. The polar factors come from the QR form of the dynamically weighted Halley
iteration, which needs no more than some six steps. Components and means then go to every task, which whitens its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, pick, table

#: Entries of 1 / GRID go to the nearest whole number below, and OFFSET is added.
GRID, OFFSET = 64, 1_000_000
#: Entries must stay below this for their places, and the distances between them, to fit a long.
LARGEST = 2.0**55
COMPONENTS = 16
#: A matrix of the square of this many numbers is divided on the driver and goes to tasks.
MAX_DIMENSIONS = 2_048
#: An eigenvalue below this share of the largest is rounding: its component is none.
RANK_SHARE = 1e-13

_EPS = np.finfo(float).eps


# -- spectral divide and conquer ----------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by dynamically weighted Halley steps with QR factorisations.

    With eigenvectors Q and eigenvalues w it is Q sign(w) Q'. Of a singular matrix, the null space may take either sign.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # the least singular value is at least one over the Frobenius norm of the inverse
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(_EPS / n, 0.9 * low if math.isfinite(low) else 0.0))
    for _ in range(40):
        s = low * low
        d = math.cbrt(4.0 * (1.0 - s) / (s * s))
        root = math.sqrt(1.0 + d)
        f = root + 0.5 * math.sqrt(max(0.0, 8.0 - 4.0 * d + 8.0 * (2.0 - s) / (s * root)))
        g = (f - 1.0) ** 2 / 4.0
        h = f + g - 1.0
        q, _ = np.linalg.qr(np.vstack([math.sqrt(h) * x, np.eye(n)]))
        new = (g / h) * x + (f - g / h) / math.sqrt(h) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2.0
        low = min(1.0, low * (f + g * s) / (1.0 + h * s))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= (5.0 * _EPS) ** (1 / 3) and 1.0 - low <= 10.0 * _EPS:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift; None where it does not part them."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2.0
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n:
        return None
    # subspace iteration on the projector, begun at its longest columns, ends after a step or two
    most = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    basis = np.linalg.qr(np.hstack([projector[:, most[:rank]], projector[:, most[rank:]]]))[0]
    for _ in range(3):
        upper = np.linalg.qr(projector @ basis[:, :rank])[0]
        lower = np.linalg.qr((np.eye(n) - projector) @ basis[:, rank:])[0]
        basis = np.linalg.qr(np.hstack([upper, lower]))[0]
    upper, lower = basis[:, :rank], basis[:, rank:]
    mixed = np.linalg.norm(lower.T @ a @ upper)
    return (upper, lower) if mixed <= 1e-13 * n * max(np.linalg.norm(a), np.finfo(float).tiny) else None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its eigenvectors in columns."""
    norm = np.linalg.norm(a)

    def divide(m: np.ndarray) -> np.ndarray:
        n = len(m)
        if n == 1:
            return np.eye(1)
        middle = np.trace(m) / n
        if np.linalg.norm(m - middle * np.eye(n)) <= 4.0 * _EPS * norm:
            return np.eye(n)  # one eigenvalue: any basis will do
        spread = np.linalg.norm(m - middle * np.eye(n)) / math.sqrt(n)
        # the mean lies strictly between the least and the largest eigenvalue; the other shifts step off an eigenvalue
        for shift in (float(np.median(np.diag(m))), middle, *(middle + k * spread / 16.0 for k in (1, -1, 3, -3, 5, -5, 7, -7))):
            if parts := _halves(m, shift):
                break
        else:
            return _jacobi(m)
        return np.hstack([basis @ divide((s + s.T) / 2.0) for basis in parts if (s := basis.T @ m @ basis) is not None])

    if not len(a):
        return np.empty(0), np.empty((0, 0))
    vectors = _polished(a, divide((a + a.T) / 2.0))
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors, optimize=True)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _polished(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Make the columns orthonormal to working precision (one Newton step towards the polar factor)."""
    return v @ (1.5 * np.eye(v.shape[1]) - 0.5 * (v.T @ v))


def _jacobi(m: np.ndarray) -> np.ndarray:
    """Plane rotations, for a block whose eigenvalues lie too near one another for any shift to part them."""
    n, v, m = len(m), np.eye(len(m)), m.copy()
    for _ in range(60):
        off = np.linalg.norm(m - np.diag(np.diag(m)))
        if off <= _EPS * np.linalg.norm(m):
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if m[p, q] == 0.0:
                    continue
                t = (m[q, q] - m[p, p]) / (2.0 * m[p, q])
                t = math.copysign(1.0, t) / (abs(t) + math.hypot(1.0, t))
                c = 1.0 / math.hypot(1.0, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                m[:, [p, q]] = m[:, [p, q]] @ turn
                m[[p, q], :] = turn.T @ m[[p, q], :]
                v[:, [p, q]] = v[:, [p, q]] @ turn
    return v


# -- the table ----------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column, all of d numbers and none null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def grid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that are whole and finite, of the length that most of them have."""
    v = pick(vectors, "vec_id", "embedding")
    c = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    place = lambda x: F.when(F.abs(x) < LARGEST, F.floor(x * GRID) + OFFSET).otherwise(F.raise_error(F.lit(f"an entry is not below {LARGEST:g}")))
    return good.select("vec_id", F.transform(c, place).alias("x"))


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums of each dimension: of the high and low halves of the values, so that no task's sum runs over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low)], ["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    got = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in fit.select("x").mapInArrow(run, "i int, high long, low long").groupBy("i").agg(exact("high"), exact("low")).collect()}
    return [got.get(i, 0) for i in range(d)]


def _covariance(fit: DataFrame, centre: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Mean outer product (a sum, to be divided) of x - centre, or of its projections; each task sends one matrix, row by row.

    centre: whole and fractional parts of the means, taken away one after the other, so that nothing is lost to rounding.
    """
    d = centre.shape[1]
    k = d if basis is None else basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for a in range(0, len(x), 4_096):
                y = _centred(x[a : a + 4_096], centre)
                y = y if basis is None else y @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "v"])

    got, out = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow(), np.zeros(k * k)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(k, k)


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x - centre[0].astype(np.int64)).astype(np.float64) - centre[1]


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n x - S) squared."""
    whole = [s // n for s in sums]
    away = x - np.array(whole, dtype=np.int64)
    rest = [s - n * w for s, w in zip(sums, whole, strict=True)]
    most = n * (int(np.abs(away).max(initial=0)) + 1)
    if len(sums) * most * most < 1 << 63:
        return ((n * away - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in away.tolist()]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every whole vector on the leading components of the distinct ones, each scaled to unit variance.

    vec_id, component (from 1, by falling variance), n (distinct vectors), deviation, whitened, explained (share of the
    variance), identity_error (largest entry of the whitened covariance less the identity; one value for all rows).

    A null vector or one with null, NaN or infinite entries gives no rows, nor does an empty one. Vectors of another length
    than the most frequent (of equally frequent ones, the longest) have no place in its space and give none. Repeated rows
    and null ids each give their rows, while equal vectors are fitted once. Without variance (a single distinct vector, or
    an empty table) there are no components and no rows; components whose variance is rounding alone are left out. A
    deviation that does not fit a long, or an entry of LARGEST or more, raises an error. Other columns are ignored.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "whitening")
    grid = grid_vectors(vectors)
    lengths = grid.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], _OUT)
    if lengths is None:
        return empty
    d = lengths["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions; the covariance of more than {MAX_DIMENSIONS} is too large for one matrix")
    grid = grid.where(F.size("x") == d)
    fit = tables.write(grid.select("x").distinct())
    n = fit.count()
    sums = _sums(fit, d)
    centre = np.array([[s // n for s in sums], [s % n / n for s in sums]])
    values, basis = spectrum(_covariance(fit, centre) / n)
    kept = min(components, int((values > RANK_SHARE * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not kept:
        tables.drop(fit)
        return empty
    scaled = basis[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(_covariance(fit, centre, scaled) / n - np.eye(kept)).max())
    tables.drop(fit)
    explained = values[:kept] / values.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4_096):
                batch = whole.slice(a, 4_096)
                x = _matrix(batch.column(1), d)
                m = len(x)
                again = pa.array(np.repeat(np.arange(m), kept))
                away = pa.array(_deviation(x, n, sums), pa.int64()).take(again)
                rows = [batch.column(0).take(again), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)), away]
                rows += [pa.array((_centred(x, centre) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))]
                yield pa.RecordBatch.from_arrays(rows, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(run, _OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
