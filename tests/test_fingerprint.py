"""Order-sensitive fingerprint against its definition."""

import hashlib

import pytest
from pyspark.sql import functions as F

from feedlens.operators.fingerprint import ordered_fingerprint


def slow(texts, fan):
    level = [hashlib.md5((t or "").encode()).hexdigest() for t in texts]
    while True:
        level = [hashlib.md5("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, max(len(level), 1), fan)]
        if len(level) == 1:
            return level[0]


def fingerprint(spark, texts, parts, fan):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos long, text string").repartition(parts)
    return tuple(ordered_fingerprint(rows, F.col("text"), ["pos"], fan).first())


@pytest.mark.parametrize("n", [0, 1, 4, 5, 17])
def test_equals_definition_for_any_partitions(spark, n):
    texts = [f"text {i % 5}" if i != 3 else None for i in range(n)]
    assert fingerprint(spark, texts, 1, 4) == fingerprint(spark, texts, 5, 4) == (n, slow(texts, 4))


def test_swapped_rows_change_it(spark):
    texts = ["a", "b", "c", "d", "e"]
    assert fingerprint(spark, texts, 2, 2) != fingerprint(spark, ["a", "b", "d", "c", "e"], 2, 2)
