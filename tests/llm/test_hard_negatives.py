"""Hard negatives against brute force over exact integers, and the bounds of the vertical scan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import hard_negatives, registry

SCHEMA = "vec_id long, embedding array<double>, label int, id string, row string, window int, slab int, score double"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def slow_negatives(rows, anchor_every=50, positives=5, negatives=3):
    """Rows ``(id, vector, label)`` that take part; repeated rows count once."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, tuple(math.floor(256 * x) for x in v), label))
    sizes = [len(v) for _, v, _ in kept]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    kept = list(dict.fromkeys(r for r in kept if len(r[1]) == dim and all(abs(x) <= math.isqrt((2**63 - 1) // dim) for x in r[1])))
    out = []
    for i, v, label in kept:
        if i % anchor_every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, w, other in kept if j != i]
        scored.sort(key=lambda s: s[:2])
        near = [s for s in scored if s[2] == label][:positives]
        for score, j, _ in near:
            fits = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(i, j, n, s[1], -score, -s[0]) for n, s in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", "y", 1, 2, 0.5) for i, v, label in rows], SCHEMA)
    return hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **kw)


def fixture(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    label = rng.choice(4, n, p=[0.5, 0.3, 0.15, 0.05])
    v = np.round(0.5 * centres[label] + rng.standard_normal((n, dim)), 1) * scale  # rounded, so that scores tie
    return [(int(i), [float(x) for x in v[i]], int(label[i])) for i in range(n)]


ODD = [
    (None, [1.0] * 6, 1), (5000, None, 1), (5050, [1.0] * 6, None), (5100, [float("nan")] * 6, 1), (5150, [float("inf")] + [1.0] * 5, 0), (5200, [None] + [1.0] * 5, 0),
    (5250, [], 2), (5300, [1.0, 2.0], 2), (5350, [0.0] * 6, 1), (5400, [1e300] * 6, 1), (5401, [1e30] * 6, 0), (5450, [-1.0] * 6, 3),
]


@pytest.mark.parametrize("block, slab", [(4096, 1 << 17), (32, 100), (7, 10)])
def test_whole_result_equals_brute_force(spark, monkeypatch, block, slab):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "SLAB_ROWS", slab)
    rows = fixture(1, 600, 6) + ODD
    rows += rows[:3] + [(7, rows[3][1], 2), (50, rows[3][1], 0), (50, rows[4][1], 0)] + [(9000 + i, rows[100][1], i % 3) for i in range(40)]
    got = mined(spark, rows)
    assert got.columns == COLUMNS
    want = slow_negatives([r for r in rows])
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("scale", [1e-3, 1.0, 300.0, 4e4])
def test_scores_are_exact_at_every_size(spark, scale):
    rows = fixture(2, 200, 9, scale)
    assert sorted(map(tuple, mined(spark, rows).collect())) == slow_negatives(rows)


def test_text_ids_one_label_and_empty_table(spark):
    rows = [(i, v, 1) for i, v, _ in fixture(3, 60, 4)]
    assert mined(spark, rows).collect() == []
    df = spark.createDataFrame([(str(i), v, label) for i, v, label in fixture(3, 120, 4)], "vec_id string, embedding array<float>, label int")
    out = hard_negatives.mine_hard_negatives(df, F.col("vec_id") == "50").collect()
    assert {r["anchor_id"] for r in out} == {"50"} and all(0.5 * r["positive_score"] <= r["negative_score"] <= 0.95 * r["positive_score"] for r in out)
    assert mined(spark, fixture(3, 2, 4)).where("false").collect() == []
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.lit(True)).collect() == []


def test_scan_returns_every_row_that_can_count():
    rng = random.Random(5)
    for seed in range(40):
        data = np.random.default_rng(seed).integers(-40, 40, (300, 12))
        anchor = data[0] * rng.choice([1, 1, 1 << 22, 1 << 44])
        block = hard_negatives.Columns(np.arange(300), np.zeros(300), data)
        exact = data @ anchor
        top = int(exact[1:].max())
        windows = sorted({(int(0.5 * top * f), int(0.95 * top * f)) for f in (1.0, 0.9, 0.3)})
        bitmap = np.random.default_rng(seed).random(300) < rng.choice([0.05, 0.9])
        found, scores = hard_negatives.scan(block, anchor, bitmap, *(np.array(x) for x in zip(*windows, strict=True)), 3)
        assert (exact[found] == scores).all() and bitmap[found].all()
        for low, high in windows:
            inside = np.flatnonzero(bitmap & (exact >= low) & (exact <= high))
            least = np.sort(exact[inside])[::-1][:3]
            assert set(inside[exact[inside] >= least[-1]] if len(least) else []) <= set(found)


def test_few_rows_are_read_to_the_last_dimension():
    data = np.random.default_rng(1).standard_normal((4000, 64))
    data = np.floor(256 * data / np.linalg.norm(data, axis=1, keepdims=True) * np.linspace(3, 0.1, 64)).astype(np.int64)
    block = hard_negatives.Columns(np.arange(4000), np.zeros(4000), data)
    found, _ = hard_negatives.scan(block, data[0], np.ones(4000, dtype=bool), -hard_negatives.OPEN, hard_negatives.OPEN, 5)
    assert 5 <= len(found) < 100 and 0 in found


def test_query_takes_every_fiftieth_row_and_shifted_labels(spark):
    rows = [(r["vec_id"], list(map(float, r["embedding"])), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = registry.op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == slow_negatives(rows)
