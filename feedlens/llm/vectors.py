"""What the operators on vectors share: usable rows and Arrow arrays to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``(id, vec)`` of the rows that can take part, in double precision, and their dimension.

    Left out are null ids, null, zero and empty vectors, those with a null or non-finite
    component and those whose length isn't the most common one.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 0
    return rows.where(F.size("vec") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long lists without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def rotation(rows: int, dim: int, seed: int) -> np.ndarray:
    """``rows`` x ``dim`` random matrix: blocks of orthonormal directions, the same for a seed everywhere."""
    rng = np.random.default_rng(seed)
    blocks = []
    while sum(len(b) for b in blocks) < rows:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        blocks.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(blocks)[:rows]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal keys in sorted columns, with 0 and the length."""
    change = np.zeros(len(keys[0]), dtype=bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.concatenate(([0], np.flatnonzero(change), [len(change)])) if len(change) else np.array([0])
