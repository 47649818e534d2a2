"""Vector columns: Catalyst expressions for dense lists and NumPy views of Arrow columns.

Two layouts are understood everywhere: a dense ``array<float|double>`` and a sparse
``struct<idx: array<int>, w: array<double>>`` with distinct, ascending ``idx``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE = "struct<idx:array<int>,w:array<double>>"


def dot(a: Column, b: Column) -> Column:
    """Dot product of two dense lists in double precision; lengths that differ are an error."""
    product = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    bad = F.raise_error(F.lit("vector dimension mismatch"))
    return F.when(F.size(a) != F.size(b), bad).otherwise(product)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def flat(arr) -> pa.Array:
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def list_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (starting at 0) and values of a list column, also of a sliced one."""
    arr = flat(arr)
    offsets = arr.offsets.to_numpy().astype(np.int64)
    values = arr.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], values.to_numpy(zero_copy_only=False)


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def sparse_array(offsets: np.ndarray, idx: np.ndarray, w: np.ndarray, null: np.ndarray) -> pa.StructArray:
    lists = [list_array(offsets, idx, pa.int32()), list_array(offsets, w, pa.float64())]
    return pa.StructArray.from_arrays(lists, ["idx", "w"], mask=pa.array(null))


#: Rows of an Arrow batch that are worked on at a time: texts and sparse vectors may be long, and a batch has up to 10,000 of them.
PART_ROWS = 512


def in_parts(work, *columns: pa.Array) -> pa.Array:
    """``work`` applied to a few rows of the columns at a time."""
    n = len(columns[0])
    return pa.concat_arrays([work(*(c.slice(at, PART_ROWS) for c in columns)) for at in range(0, max(n, 1), PART_ROWS)])


class Rows:
    """The vectors of one Arrow column, ready for matrix products between bounded row blocks."""

    def __init__(self, column):
        column = flat(column)
        self.n = len(column)
        self.sparse = pa.types.is_struct(column.type)
        if self.sparse:
            parts = column.flatten()
            names = [column.type.field(i).name for i in range(column.type.num_fields)]
            self.offsets, idx = list_parts(parts[names.index("idx")])
            self.idx = idx.astype(np.int64)
            self.w = list_parts(parts[names.index("w")])[1].astype(np.float64)
        else:
            offsets, values = list_parts(column)
            widths = np.diff(offsets)
            if self.n and (widths != widths[0]).any():
                raise ValueError("vector dimension mismatch")
            self.dense = values.astype(np.float64).reshape(self.n, -1)

    def features(self) -> np.ndarray:
        return np.unique(self.idx)

    def block(self, start: int, stop: int, lookup=None, width: int = 0) -> np.ndarray:
        """Rows start..stop as a dense matrix; sparse ones over the features of ``lookup``."""
        if not self.sparse:
            return self.dense[start:stop]
        lo, hi = self.offsets[start], self.offsets[stop]
        owner = np.repeat(np.arange(stop - start), np.diff(self.offsets[start : stop + 1]))
        column = lookup(self.idx[lo:hi])
        known = column >= 0
        out = np.zeros((stop - start, width))
        out[owner[known], column[known]] = self.w[lo:hi][known]
        return out


class FeatureMap:
    """Feature number -> local column, -1 for unknown features."""

    def __init__(self, features: np.ndarray):
        self.features = features

    def __call__(self, idx: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(idx), -1)
        at = np.searchsorted(self.features, idx).clip(max=len(self.features) - 1)
        return np.where(self.features[at] == idx, at, -1)


# decimals kept of every similarity, so that equal vectors tie exactly in any block order
SIM_DIGITS = 9
_CHUNK = 4096


def similarity(a: Rows, b: Rows, digits: int | None = SIM_DIGITS) -> np.ndarray:
    """All dot products between two bounded row sets, rounded unless ``digits`` is None."""
    if not a.n or not b.n:
        return np.zeros((a.n, b.n))
    if not a.sparse:
        if a.dense.shape[1] != b.dense.shape[1]:
            raise ValueError("vector dimension mismatch")
        return _rounded(a.dense @ b.dense.T, digits)
    shared = np.intersect1d(a.features(), b.features())
    out = np.zeros((a.n, b.n))
    for lo in range(0, len(shared), _CHUNK):
        lookup = FeatureMap(shared[lo : lo + _CHUNK])
        width = len(lookup.features)
        out += a.block(0, a.n, lookup, width) @ b.block(0, b.n, lookup, width).T
    return _rounded(out, digits)


def _rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    return values if digits is None else np.round(values, digits)


def row_dots(a: Rows, b: Rows) -> np.ndarray:
    """Dot product of row i of ``a`` with row i of ``b``."""
    if not a.sparse:
        return np.round(np.einsum("ij,ij->i", a.dense, b.dense), SIM_DIGITS)
    owner_a = np.repeat(np.arange(a.n), np.diff(a.offsets))
    owner_b = np.repeat(np.arange(b.n), np.diff(b.offsets))
    top = 1 + max(a.idx.max(initial=0), b.idx.max(initial=0))
    key_a, key_b = owner_a * top + a.idx, owner_b * top + b.idx
    _, at_a, at_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    return np.round(np.bincount(owner_a[at_a], a.w[at_a] * b.w[at_b], minlength=a.n), SIM_DIGITS)


def pair_similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity of two vector columns row by row."""

    @F.arrow_udf("double")
    def dots(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_parts(lambda x, y: pa.array(row_dots(Rows(x), Rows(y)), pa.float64()), a, b)

    return dots.asNondeterministic()(a, b)
