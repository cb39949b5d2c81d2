"""What the two vector operators share: valid rows, bounded samples, Arrow to numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: str = "embedding") -> Column:
    """Vectors with a direction: not null, all components finite, some component not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def doubles(df: DataFrame) -> DataFrame:
    """(vec_id, v: array of double, d: its dimension) of the valid rows."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(valid("v")).withColumn("d", F.size("v").cast("long"))


def sample(rows: DataFrame, count: int, most: int, ident: str) -> dict[int, np.ndarray]:
    """About ``most`` vectors at most, chosen by a hash of their id, by dimension.

    A dimension that few vectors have may be missing.
    """
    share = min(1.0, most / max(1, count))
    parts = 1 << 30
    kept = rows.where(F.pmod(F.xxhash64(ident, F.lit(3)), F.lit(parts)) < int(share * parts)) if share < 1 else rows
    found: dict[int, list] = {}
    for d, v in kept.select("d", "v", ident).orderBy(ident).select("d", "v").collect():
        found.setdefault(d, []).append(v)
    return {d: np.array(x, dtype=np.float64) for d, x in found.items()}


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) of the vectors of a column."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, matrix(column if len(at) == len(sizes) else column.take(pa.array(at)), int(d))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]  # no square overflows or vanishes
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def vectors_column(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))
