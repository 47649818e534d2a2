"""Bootstrap by a tree of splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.operators.resample import DrawTree, resample_sums, tree_bootstrap_ci


def counts(tree):
    """Draws per (replicate, row), one row at a time."""
    out = np.zeros((tree.replicates, tree.n), dtype=np.int64)
    for i in range(tree.n):
        out[:, i] = tree.leaf_sums(i // tree.leaf_rows, np.array([i % tree.leaf_rows]), np.array([1.0]))[1]
    return out


@pytest.mark.parametrize("n", [1, 7, 8, 9, 37])
def test_every_replicate_has_n_draws(n):
    assert (counts(DrawTree(n, 50, 3, leaf_rows=4)).sum(axis=1) == n).all()


def test_counts_have_the_moments_of_a_multinomial():
    n, replicates = 24, 6000
    c = counts(DrawTree(n, replicates, 5, leaf_rows=5))
    assert np.abs(c.mean(axis=0) - 1.0).max() < 0.07
    covariance = np.cov(c.T)
    expected = np.eye(n) - 1.0 / n
    assert np.abs(covariance - expected).max() < 0.12
    zeros = (c == 0).mean()
    assert abs(zeros - (1 - 1 / n) ** n) < 0.01


def test_order_of_leaves_does_not_matter():
    forth, back = DrawTree(100, 20, 1, leaf_rows=4), DrawTree(100, 20, 1, leaf_rows=4)
    a = [forth.leaf_draws(leaf) for leaf in range(25)]
    b = [back.leaf_draws(leaf) for leaf in reversed(range(25))][::-1]
    assert np.array_equal(a, b)


def test_same_sums_for_any_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 17).cast("double").alias("value"))
    one = resample_sums(rows.coalesce(1), 1000, 40, 9, 16).orderBy("replicate").collect()
    many = resample_sums(rows.repartition(7), 1000, 40, 9, 16).orderBy("replicate").collect()
    assert one == many and {r["draws"] for r in one} == {1000}
    tree, value = DrawTree(1000, 40, 9, 16), np.arange(1000) % 17
    assert np.array_equal(counts(tree) @ value, [r["total"] for r in one])


def test_interval_is_that_of_the_normal_approximation(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), (F.pmod(F.hash("id"), F.lit(1000)) / 10.0).alias("value"))
    got = tree_bootstrap_ci(rows, "value", ["k"]).first()
    value = np.array([r["value"] for r in rows.collect()])
    half = 1.96 * value.std() / np.sqrt(len(value))
    assert got["n"] == 4000 and got["mean"] == round(value.mean(), 4)
    assert abs(got["ci_lower"] - (value.mean() - half)) < 0.15 * half
    assert abs(got["ci_upper"] - (value.mean() + half)) < 0.15 * half


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 2.0), (3, None)], "k int, value double")
    assert tuple(tree_bootstrap_ci(rows, "value", ["k"]).first()) == (3, 2.0, 2.0, 2.0)
    assert tuple(tree_bootstrap_ci(rows.where("k = 9"), "value", ["k"]).first()) == (0, None, None, None)


def test_shuffle_has_one_row_per_replicate_and_task(spark):
    text = resample_sums(spark.range(10).selectExpr("id i", "1.0 value"), 10, 4, 1)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text
