"""Text -> dense unit vector: truncated SVD of the TF-IDF rows by a distributed randomised range finder.

The rows meet a seeded Gaussian block. One pass gives a tree of QR factors over the partitions,
which orthonormalises the products, and the rows times the products, which the factor turns into
the projection. What leaves the tasks has a size that depends on the number of features and
dimensions alone, so the fitted basis can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import vectors as V
from feedlens.operators.encode import TextEncoder, fit_text_encoder
from feedlens.session import materialise, spread

#: Features of the encoder below; with the dimensions they set the size of the basis (16 MB by default).
DENSE_FEATURES = 1 << 16
#: Products that are stacked before they are factored.
FACTOR_ROWS = 1024
#: Partial results that one task of the tree combines.
FAN_IN = 32
#: Features of one block of a partial projection.
BLOCK_FEATURES = 4096


@dataclass
class DenseEncoder:
    """Fitted encoder: ``basis`` has one row per feature and one column per dimension, ``singular`` the singular values."""

    base: TextEncoder
    basis: Broadcast
    singular: np.ndarray

    def column(self, text: Column) -> Column:
        """The unit vector of a text; null for a blank one and for one without any feature in the basis."""
        shared = self.basis

        @F.arrow_udf("array<double>")
        def project(vec: pa.Array) -> pa.Array:
            basis = shared.value
            out = np.zeros((len(vec), basis.shape[1]))
            some = np.flatnonzero(~V.flat(vec).is_null().to_numpy(zero_copy_only=False))
            for row, (feature, weight) in zip(some, _sparse_rows(V.flat(vec).take(pa.array(some))), strict=True):
                out[row] = weight @ basis[feature]
            length = np.linalg.norm(out, axis=1)
            good = length > 1e-12
            out[good] /= length[good, None]
            offsets = np.concatenate([[0], np.cumsum(good)]) * basis.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out[good].ravel()), mask=pa.array(~good))

        return project.asNondeterministic()(self.base.column(text))

    def encode(self, df: DataFrame, text: Column | str, into: str = "vec") -> DataFrame:
        text = F.col(text) if isinstance(text, str) else text
        return spread(df).withColumn(into, self.column(text))


def fit_dense_encoder(
    texts: DataFrame, text: Column | str, dims: int = 64, oversample: int = 16, rounds: int = 2,
    num_features: int = DENSE_FEATURES, seed: int = 42,
) -> DenseEncoder:
    """The ``dims`` leading right singular vectors of the TF-IDF rows of all texts.

    Each of the ``rounds`` multiplies the rows with the current block (first a Gaussian one of
    ``dims + oversample`` columns, then the projection of the round before), orthonormalises and
    projects back: the first finds the range, every further one sharpens it as a power
    iteration does. Fewer dimensions come out where the rows have a lower rank.
    """
    text = F.col(text) if isinstance(text, str) else text
    base = fit_text_encoder(texts, text, num_features)
    rows = materialise(spread(texts).select(base.column(text).alias("vec")).where("vec is not null"))
    context = texts.sparkSession.sparkContext
    block = np.random.default_rng(seed).standard_normal((num_features, dims + oversample))
    singular = np.zeros(0)
    for _ in range(max(1, rounds)):
        shared = context.broadcast(block.astype(np.float32))
        factor, product = sketch(rows, shared, num_features)
        if factor is None:
            block = np.zeros((num_features, 0))
            break
        # Q = Y W / s has orthonormal columns; directions without extent are left out
        _, s, wt = np.linalg.svd(factor, full_matrices=False)
        keep = s > s[0] * 1e-10
        block, singular, _ = np.linalg.svd(product @ (wt[keep].T / s[keep]), full_matrices=False)
    kept = (singular > singular[:1].max(initial=0.0) * 1e-6)[:dims]
    basis = np.ascontiguousarray(block[:, :dims][:, kept]) if len(kept) else np.zeros((num_features, 1))
    return DenseEncoder(base, context.broadcast(basis.astype(np.float32)), singular[:dims][kept])


def _sparse_rows(vec: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and weights of each row."""
    rows = V.Rows(vec)
    for start, stop in zip(rows.offsets[:-1].tolist(), rows.offsets[1:].tolist(), strict=True):
        yield rows.idx[start:stop], rows.w[start:stop]


_PART = "part bigint, block int, rows int, cells binary"


def _part(part: int, block: int, matrix: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([len(matrix)], pa.int32()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "rows", "cells"])


def _matrices(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(cells, dtype="<f8").reshape(n, -1) for n, cells in zip(table.column("rows").to_pylist(), table.column("cells").to_pylist(), strict=True)]


def _tree(parts: DataFrame, combine) -> list[tuple[int, np.ndarray]]:
    """``(block, matrix)`` of partial results, combined ``FAN_IN`` at a time in rounds until one per block is left."""

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # one order, whatever came first
        block = table.column("block")[0].as_py()
        return pa.Table.from_batches([_part(table.column("part")[0].as_py() // FAN_IN, block, combine(block, _matrices(table)))])

    parts = materialise(parts)
    while parts.groupBy("block").count().where("count > 1").limit(1).count():
        grouped = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("g"), "block")
        parts = materialise(grouped.applyInArrow(merged, _PART))
    done = parts.toArrow()
    return list(zip(done.column("block").to_pylist(), _matrices(done), strict=True))


def sketch(rows: DataFrame, shared: Broadcast, num_features: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The R factor of Y, which is all rows times the block, and the rows transposed times Y: features x columns.

    Each task folds its rows into one factor and one product; the tree stacks and factors the factors and adds the products.
    """
    factors = -1

    def fold(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), shared.value
        factor, held = np.zeros((0, block.shape[1])), []
        total = np.zeros((num_features, block.shape[1]))
        for batch in batches:
            for feature, weight in _sparse_rows(batch.column(0)):
                held.append(weight @ block[feature])
                total[feature] += np.outer(weight, held[-1])
                if len(held) == FACTOR_ROWS:
                    factor, held = np.linalg.qr(np.vstack((factor, *held)), mode="r"), []
        if held:
            factor = np.linalg.qr(np.vstack((factor, *held)), mode="r")
        if len(factor):
            yield _part(part, factors, factor)
        for at in range(0, num_features, BLOCK_FEATURES):
            if total[at : at + BLOCK_FEATURES].any():
                yield _part(part, at, total[at : at + BLOCK_FEATURES])

    def combine(block: int, parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(parts), mode="r") if block == factors else np.sum(parts, axis=0)

    factor, product = None, np.zeros((num_features, shared.value.shape[1]))
    for block, matrix in _tree(rows.mapInArrow(fold, _PART), combine):
        if block == factors:
            factor = matrix
        else:
            product[block : block + len(matrix)] = matrix
    return factor, product
