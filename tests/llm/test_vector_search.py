"""Vector dedup and nearest neighbours against brute force in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import near_vectors, neighbours

SCHEMA = "vec_id long, embedding array<float>, id string, vec int, w int, code int, tree int"


def table(spark, vectors, ids=None, odd=True):
    ids = list(range(len(vectors))) if ids is None else ids
    rows = [(int(i), [float(x) for x in v], "x", 1, 2, 3, 4) for i, v in zip(ids, vectors, strict=True)]
    if odd:
        d = len(vectors[0])
        for i, v in enumerate(([0.0] * d, None, [float("nan")] * d, [1.0, None] * (d // 2), [float("inf")] + [1.0] * (d - 1), [1.0, 2.0], [])):
            rows.append((100_000 + 100 * i, v, "x", 1, 2, 3, 4))
        rows.append((None, [1.0] * d, "x", 1, 2, 3, 4))
    return spark.createDataFrame(rows, SCHEMA)


def clustered(seed, n=500, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[rng.integers(0, n // 5, n // 2)] + rng.standard_normal((n // 2, dim)) * rng.choice([0.02, 0.1, 0.2, 0.3], (n // 2, 1))
    hot = base[0] + rng.standard_normal((n // 3, dim)) * 0.05
    return np.concatenate([base, near, hot, base[:40], base[:3], base[:40] * 2.5]).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)
    v = clustered(1)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    low = np.arange(len(v))
    while True:
        new = np.minimum(low, np.where(link, low[None, :], len(v)).min(axis=1))
        if (new == low).all():
            break
        low = new
    out = {r["vec_id"]: r for r in near_vectors.near_duplicate_vectors(table(spark, v)).collect()}
    assert len(out) == len(v) + 8
    wrong = [i for i in range(len(v)) if (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) != (link[i].sum(), low[i], low[i] == i)]
    assert not wrong
    assert all(r["n_links"] == 0 and r["component_id"] == i and r["kept"] for i, r in out.items() if i is None or i >= 100_000)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    from feedlens.llm.vectors import rotation

    x, y = rng.standard_normal(48), rng.standard_normal(48)
    y = 0.9 * x / np.linalg.norm(x) + 0.436 * y / np.linalg.norm(y)
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    found = []
    for seed in range(300):
        turn = rotation(96, 48, seed)
        packed, factor = near_vectors.encode(y[None], turn)
        signs = 2 * np.unpackbits(packed, axis=1)[:, :96].astype(np.int8) - 1
        found.append(near_vectors.estimate((x[None] @ turn.T).astype(np.float32), signs, factor)[0, 0])
        assert near_vectors.worth_exact(np.array([found[-1]]), factor, 96, float(x @ y)).all()
    assert abs(np.mean(found) - x @ y) < 0.01


def test_pairs_at_the_threshold_share_a_cell_in_large_tables():
    tables = near_vectors._tables(100_000_000, 256, 0.95)
    assert len(np.unique(np.concatenate(tables))) == sum(map(len, tables)) and min(map(min, tables)) >= 256
    rng = np.random.default_rng(5)
    directions = near_vectors.key_directions(tables, 64)
    missed = 0
    for _ in range(20):  # 20,000 pairs
        x, other = rng.standard_normal((2, 1000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        other -= (other * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
        a, b = (near_vectors._keys(np.unpackbits(np.concatenate((np.zeros((1000, 32), np.uint8), near_vectors.key_bits(v, directions)), axis=1), axis=1), tables) for v in (x, y))
        missed += int((a != b).all(axis=1).sum())
    assert missed <= 3  # 0.2 are expected, 28 where tables share the bits of the code


def test_empty_and_unusable_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors.near_duplicate_vectors(empty).collect() == []
    assert neighbours.nearest_neighbours(empty, F.col("vec_id") % 100 == 0).collect() == []
    bad = spark.createDataFrame([(0, None, "x", 1, 2, 3, 4), (100, [0.0, 0.0], "x", 1, 2, 3, 4)], SCHEMA)
    assert sorted(r["n_links"] for r in near_vectors.near_duplicate_vectors(bad).collect()) == [0, 0]
    assert neighbours.nearest_neighbours(bad, F.col("vec_id") % 100 == 0).collect() == []


def test_few_rows_give_all_candidates_in_order(spark):
    v = np.array([[1, 0], [0, 1], [0, 1], [3, 4]], dtype=float)
    out = neighbours.nearest_neighbours(table(spark, v, odd=False), F.col("vec_id") == 0, k=10).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in out] == [(1, 1), (2, 2), (3, 3)]
    assert out[0]["score"] == np.sqrt(2.0) and out[2]["score"] == np.sqrt(20.0)


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    v = clustered(2, n=900)
    ids = np.arange(len(v)) * 10
    out = neighbours.nearest_neighbours(table(spark, v, ids), F.col("vec_id") % 100 == 0).collect()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        d = np.sqrt(((v - v[q // 10]) ** 2).sum(axis=1))
        d[q // 10] = np.inf
        order = np.lexsort((ids, d))[:10]
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        assert all(m[2] == pytest.approx(d[m[1] // 10], abs=1e-12) for m in mine)
        hit += len({m[1] for m in mine} & {int(i) for i in ids[order]})
        total += 10
    assert hit >= 0.9 * total
    assert {r["query_id"] for r in out} == {int(q) for q in ids if q % 100 == 0}


def test_common_prefix_of_hash_strings():
    a = np.array([0, 1, 1 << 63, 7 << 32, 2**64 - 1, 5], dtype=np.uint64)
    b = np.array([0, 0, 0, 6 << 32, 2**64 - 2, 5 + (1 << 40)], dtype=np.uint64)
    assert neighbours.common_prefix(a, b).tolist() == [64, 63, 0, 31, 63, 23]
