"""Vectors of whole numbers, as the operators on embeddings read them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component becomes the floor of this many times its value.
SCALE = 256.0
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


def scaled(vector: str) -> Column:
    """The vector's components as whole numbers; NULL where the vector or a component is none or not finite."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(parts, lambda x: F.floor(x * SCALE).cast("long"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def width(df: DataFrame, vector: str) -> int:
    """Components of the longest vector, 0 without rows."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values, dtype=np.int64)[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)] = values
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``left`` with all rows of ``right``, exact."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if largest * left.shape[1] < EXACT:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left @ right.T
