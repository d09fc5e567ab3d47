"""Vector columns: which rows take part, and their entries as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_col: str, zero: bool) -> tuple[DataFrame, int]:
    """Rows whose vector takes part, and the number of its entries (0: there is no such row).

    Vectors that are null, empty or hold a null or non-finite entry take no part, nor do those whose length isn't the
    most common one (ties: the shorter), nor, unless zero, those of zeros only."""
    v = F.col(vec_col)
    finite = lambda x: F.abs(x.cast("double")) < float("inf")  # noqa: E731  NaN is above infinity here
    whole: Column = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False)))
    if not zero:
        whole = whole & F.exists(v, lambda x: x != 0)
    rows = df.where(whole)
    first = rows.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = first["dim"] if first else 0
    return rows.where(F.size(v) == dim), dim


def entry_type(df: DataFrame, vec_col: str) -> np.dtype:
    """Floats stay what they are, all other numbers become doubles."""
    return np.dtype("<f4" if df.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8")


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, one a row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(len(col), dim)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unpacked(col: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    """The matrix that packed() took apart."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dim), kind)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int32)[col.offset]
    return np.frombuffer(data, kind, len(col) * dim, int(at)).reshape(len(col), dim)
