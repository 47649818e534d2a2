"""Bootstrap of a mean whose resamples are split down a tree over row positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import round_half_even
from feedlens.operators.number import number_rows

#: Rows of a leaf; a task holds about three numbers per replicate and row of one leaf.
LEAF_ROWS = 256
#: Draws of a task. The work per row grows with the replicates, so partitions that are right by size are too few.
TASK_DRAWS = 32_000_000
SUMS = "replicate int, total double, draws bigint"


class DrawTree:
    """How often every resample of ``n`` rows takes each row, as a function of seed and position only.

    A node is a range of positions. Of the draws that fall into it, a binomial number falls into its left
    half, all replicates at once, from a generator keyed by the node. A leaf deals its draws evenly over its
    rows. The counts are multinomial and add up to ``n`` in each replicate; any task can compute
    those of its own rows, in time for the path to them, so nothing is sent around.
    """

    def __init__(self, n: int, replicates: int, seed: int, leaf_rows: int = LEAF_ROWS) -> None:
        self.n, self.replicates, self.seed, self.leaf_rows = n, replicates, seed, leaf_rows
        self.leaves = max(-(-n // leaf_rows), 1)
        # the path to the leaf asked for last: (first leaf, end, draws per replicate)
        self._path = [(0, self.leaves, np.full(replicates, n, dtype=np.int64))]

    def _generator(self, *node: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, *node])))

    def _rows(self, first: int, end: int) -> int:
        return min(end * self.leaf_rows, self.n) - first * self.leaf_rows

    def leaf_draws(self, leaf: int) -> np.ndarray:
        """Draws per replicate that fall into a leaf; leaves asked for in order share their paths."""
        while not self._path[-1][0] <= leaf < self._path[-1][1]:
            self._path.pop()
        first, end, draws = self._path[-1]
        while end - first > 1:
            middle = (first + end) // 2
            share = self._rows(first, middle) / self._rows(first, end)
            left = self._generator(0, first, end).binomial(draws, share)
            if leaf < middle:
                end, draws = middle, left
            else:
                first, draws = middle, draws - left
            self._path.append((first, end, draws))
        return draws

    def leaf_sums(self, leaf: int, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the drawn values and number of draws per replicate, over the given rows (offsets in the leaf)."""
        draws = self.leaf_draws(leaf)
        size = self._rows(leaf, leaf + 1)
        of = np.repeat(np.arange(self.replicates), draws)
        row = self._generator(1, leaf).integers(size, size=len(of))
        held, value = np.zeros(size), np.zeros(size)
        held[rows], value[rows] = 1.0, values
        totals = np.bincount(of, weights=value[row], minlength=self.replicates)
        return totals, np.bincount(of, weights=held[row], minlength=self.replicates).astype(np.int64)


def resample_sums(numbered: DataFrame, n: int, replicates: int, seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(replicate, total, draws)`` of all resamples of rows ``(i, value)`` numbered 0..n-1.

    Each task adds up its part of all replicates, so ``replicates`` rows per task are shuffled. Rows themselves
    are moved once, by position, where the draws need more than one task.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = DrawTree(n, replicates, seed, leaf_rows)
        totals, draws, seen = np.zeros(replicates), np.zeros(replicates, dtype=np.int64), False
        for batch in batches:
            at, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(at, kind="stable")
            at, values = at[order], values[order]
            leaves, begins = np.unique(at // leaf_rows, return_index=True)
            for leaf, begin, end in zip(leaves.tolist(), begins, [*begins[1:], len(at)], strict=True):
                t, d = tree.leaf_sums(leaf, at[begin:end] - leaf * leaf_rows, values[begin:end])
                totals, draws, seen = totals + t, draws + d, True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(replicates, dtype=np.int32)), pa.array(totals), pa.array(draws)], ["replicate", "total", "draws"]
            )

    rows = numbered.select(F.col("i").cast("bigint"), F.col("value").cast("double"))
    tasks = -(-n * replicates // TASK_DRAWS)
    if tasks > 1:
        rows = rows.repartitionByRange(tasks, "i")  # neighbouring rows share leaves and paths
    parts = rows.mapInArrow(add_up, SUMS)
    return parts.groupBy("replicate").agg(F.sum("total").alias("total"), F.sum("draws").alias("draws"))


def tree_bootstrap_ci(
    values: DataFrame, value: str, order: list[str], replicates: int = 1000, ci: float = 95.0, seed: int = 42, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """``(n, mean, ci_lower, ci_upper)``: percentile interval of the mean over resamples of the whole column.

    Unlike ``evaluate.bootstrap_ci`` no row exists per replicate and draw. Rows are numbered by ``order`` and then
    by value, so the answer depends on the seed and the data but not on partitions. Null values take no
    part; without any value there is one row with n = 0 and nulls.
    """
    known = values.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_o{j}") for j, c in enumerate(order)], F.col(value).cast("double").alias("value"))
    numbered = number_rows(known, [*[f"_o{j}" for j in range(len(order))], "value"]).select("i", "value")
    whole = numbered.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).first()
    tail = (100.0 - ci) / 200.0
    means = resample_sums(numbered, whole["n"], replicates, seed, leaf_rows).select((F.col("total") / F.col("draws")).alias("m"))
    return means.agg(
        F.lit(whole["n"]).cast("bigint").alias("n"),
        round_half_even(F.lit(whole["mean"]).cast("double"), 4).alias("mean"),
        round_half_even(F.percentile("m", F.lit(tail)), 4).alias("ci_lower"),
        round_half_even(F.percentile("m", F.lit(1.0 - tail)), 4).alias("ci_upper"),
    )
