"""Embedding whitening by a two-pass covariance.

Entries become integers, so the first pass gets the mean's sums exactly. The second pass sums outer products of the
centred vectors, one matrix product (GEMM) for each batch; treeAggregate merges what the partitions have, LAPACK's
symmetric eigensolver runs once on a matrix of dimensions x dimensions, and the projection goes to the executors as a
broadcast. A third pass measures the covariance of what comes out.

Defined cases: a vector that is null, empty, holds a null or non-finite entry, or hasn't the table's most common length
(ties: the shorter) is dropped; zeros, ties and repeated rows are ordinary rows of the fit; no rows, no result. Entries
beyond +-2^40 count as +-2^40. Where the vectors span fewer dimensions than components are asked for, the components
without variance (at most 1e-12 of the trace) are 0 for every row, and identity_error is taken over the others.
deviation is exact, null beyond 38 digits. Memory: a few matrices of dimensions x dimensions, so dimensions are
MAX_DIMENSIONS at most."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.kernel import lean
from shardwright.llm.vectors import matrix, usable

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
MOST_ENTRY = float(1 << 40)
MAX_DIMENSIONS = 4096
#: Rows of a batch that are worked on at a time: entries are BATCH at most.
BATCH = 1 << 21
DIGITS = 38


def integers(entries: np.ndarray) -> np.ndarray:
    scaled = np.clip(entries.astype(np.float64), -MOST_ENTRY, MOST_ENTRY) * SCALE
    return np.floor(scaled).astype(np.int64) + SHIFT


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    step = max(1, BATCH // dim)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield lo, integers(matrix(part.column(0), dim)), part


def _merged(vectors: DataFrame, dim: int, of: Callable[[np.ndarray], tuple], add: Callable[[tuple, tuple], tuple]) -> tuple | None:
    """of() each slice of vectors, added up: within a task, then between tasks as a tree."""

    def run(batches):
        total = None
        for _, x, _ in _parts(batches, dim):
            total = of(x) if total is None else add(total, of(x))
        if total is not None:
            yield pa.record_batch({"part": pa.array([pickle.dumps(total)], pa.binary())})

    def merge(a, b):
        return b if a is None else a if b is None else add(a, b)

    parts = vectors.mapInArrow(lean(run), "part binary").rdd
    return parts.treeAggregate(None, lambda a, row: merge(a, pickle.loads(row["part"])), merge)


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


class Centre:
    """The exact mean S/n, as whole numbers and remainders, so that centring loses nothing to the size of x."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n = n
        pairs = [divmod(int(s), n) for s in sums]
        self.whole = np.array([q for q, _ in pairs], np.int64)
        self.rest = np.array([r for _, r in pairs], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n*x - S)^2, exactly: in 64 bits where all of it fits, else in Python's integers."""
        d = x - self.whole
        far = int(np.abs(d).max(initial=0)) * self.n + self.n
        if far * far * x.shape[1] < 1 << 63:
            y = d * self.n - self.rest
            return pa.array((y * y).sum(1)).cast(pa.decimal128(DIGITS, 0))
        y = d.astype(object) * self.n - self.rest.astype(object)
        every = ((y * y).sum(1)).tolist()
        return pa.array([Decimal(v) if v < 10**DIGITS else None for v in every], pa.decimal128(DIGITS, 0))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) by falling eigenvalue, the eigenvalues, their shares of the trace. A vector's sign is
    such that its entry of largest size is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = np.trace(covariance)
    return vectors, values, values / trace if trace > 0 else np.zeros(len(order))


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component from 1, n, deviation decimal, whitened, explained, identity_error), a row for each usable row of df
    and each component up to the number asked for (or of dimensions)."""
    rows, dim = usable(df.select(F.col(vec_col).alias("v"), F.col(id_col).alias("id")), "v", zero=True)
    id_type = df.schema[id_col].dataType.simpleString()
    shape = f"{id_col} {id_type}, component int, n long, deviation decimal({DIGITS},0), whitened double, explained double, identity_error double"
    spark = df.sparkSession
    if not dim:
        return spark.createDataFrame([], shape)
    if dim > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {dim} entries: a covariance of more than {MAX_DIMENSIONS} dimensions doesn't go into one task")
    vectors, k = rows.select("v"), min(components, dim)

    n, sums = _merged(vectors, dim, lambda x: (len(x), x.astype(object).sum(0) if np.abs(x).max() > 1 << 31 else x.sum(0).astype(object)), _plus)
    centre = Centre(n, sums)
    (outer,) = _merged(vectors, dim, lambda x: ((c := centre(x)).T @ c,), _plus)
    outer = (outer + outer.T) / 2 / n
    axes, values, explained = components_of(outer, k)
    real = values > 1e-12 * np.trace(outer)
    projection = axes * np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0.0)
    shared = spark.sparkContext.broadcast((centre, projection))

    def seen(x):
        c, p = shared.value
        w = c(x) @ p
        return w.sum(0), w.T @ w

    total, square = _merged(vectors, dim, seen, _plus)
    mean = total / n
    off = square / n - np.outer(mean, mean) - np.eye(k)
    error = float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))

    def run(batches):
        c, p = shared.value
        for _, x, part in _parts(batches, dim):
            w = c(x) @ p
            flat = pa.array(np.ascontiguousarray(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.record_batch({"id": part.column(1), "deviation": c.deviation(x), "w": lists})

    wide = rows.mapInArrow(lean(run), f"id {id_type}, deviation decimal({DIGITS},0), w array<double>")
    shares = F.array(*(F.lit(float(e)) for e in explained))
    long = wide.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
