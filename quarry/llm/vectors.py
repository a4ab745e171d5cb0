"""Integer vectors from a column of embeddings, and their Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Components beyond these can't be told from wrong units, and their products leave 64 bits.
MOST = 1 << 31


def whole_vectors(rows: DataFrame, vector: str, factor: int) -> Column:
    """floor(factor * x) of each component as array<int>; null where the vector is null or has null or non-finite components.

    A finite component whose floor leaves 32 bits fails the query with a message.
    """
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: F.abs(v.cast("double")) < F.lit(float("inf")))
    scaled = lambda v: F.floor(F.lit(float(factor)) * v.cast("double"))
    fits = lambda v: F.when(F.abs(scaled(v)) < MOST, scaled(v)).otherwise(F.raise_error(F.lit(f"a component times {factor} leaves 32 bits")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(x, lambda v: fits(v).cast("int")))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components end to end, and the length of each vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows that have it, and their matrix."""
    values, lengths = lists(column)
    ends = np.cumsum(lengths)
    out = []
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out.append((at, values[(ends[at] - n)[:, None] + np.arange(n)]))
    return out
