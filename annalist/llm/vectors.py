"""Integer vectors for the search and clustering operators: which rows take part, and exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import small_batches

#: Up to here every integer is a double.
EXACT = float(1 << 53)
LONGS = -(1 << 63), (1 << 63) - 1


def integers(df: DataFrame, scale: int, id_col: str = "vec_id", vector: str = "embedding", more: dict[str, Column] | None = None) -> DataFrame:
    """vec_id, v and the columns ``more`` of the rows that take part, whatever else the table holds.

    A component x becomes floor(scale * x), x as double; beyond the range of a long it stays at the end of that range.
    Rows whose id or vector is null, and vectors with a null or non-finite component, take no part.
    """
    small_batches(df.sparkSession)
    v = F.col(vector).cast("array<double>")
    more = more or {}
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *(c.alias(name) for name, c in more.items()))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def most(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; beyond the range of a long they stay at its end."""
    bound = most(a) * most(b) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, *LONGS).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices; beyond the range of a long they stay at its end."""
    bound = 4 * max(most(a), most(b)) ** 2 * a.shape[1]
    kind = np.float64 if bound < EXACT else np.int64 if bound < 2.0**62 else object
    a, b = a.astype(kind), b.astype(kind)
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return (np.clip(out, *LONGS) if kind is object else out).astype(np.int64)


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of a column, all of one width, as rows of a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def widths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False)


def packed(x: np.ndarray) -> bytes:
    """The smallest integers that hold the matrix, after a byte that tells their size."""
    m = most(x)
    size = next((s for s, top in ((1, 2.0**7), (2, 2.0**15), (4, 2.0**31)) if m < top), 8)
    return bytes([size]) + np.ascontiguousarray(x, f"<i{size}").tobytes()


def unpacked(held: bytes, width: int) -> np.ndarray:
    return np.frombuffer(held, f"<i{held[0]}", offset=1).reshape(-1, width) if width else np.zeros((0, 0), np.int64)
