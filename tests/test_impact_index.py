"""Block bounds against plain scoring."""

import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators import impact_index
from feedlens.plans import tables

SF = "/root/testdata/sf0.001"
SCHEMA = "struct<idx:array<int>,val:array<double>>"


def vector(rng, features, negative):
    idx = sorted(rng.sample(range(features), rng.randrange(1, 9)))
    return idx, [round(rng.choice((0.1, 0.25, 0.5, rng.random())) * (-1 if negative and rng.random() < 0.3 else 1), 3) for _ in idx]


def slow(proposals, tickets, k, threshold):
    out = set()
    for pid, q in proposals:
        if q is None:
            continue
        w = dict(zip(*q, strict=True))
        found = [(round(sum(w.get(i, 0.0) * v for i, v in zip(*t, strict=True)), 9), pos) for pos, t in tickets if t is not None]
        best = sorted((x for x in found if x[0] >= threshold), reverse=True)[:k]
        out |= {(pid, pos, s, r + 1) for r, (s, pos) in enumerate(best)}
    return out


@pytest.mark.parametrize("block_rows, negative, k", [(1, False, 5), (8, False, 3), (8, True, 5), (10_000, True, 1)])
def test_equals_plain_scoring(spark, block_rows, negative, k):
    rng = random.Random(block_rows)
    # a hot feature is the heaviest of a third of all tickets; copies tie
    tickets = [(i, vector(rng, 40, negative) if i % 3 else ([0, 1 + i % 20], [3.0, 0.5])) for i in range(600)]
    tickets += [(600, None), (601, ([], [])), (602, ([5], [0.0])), (603, tickets[1][1]), (604, tickets[1][1])]
    proposals = [(i, vector(rng, 40, negative)) for i in range(25)] + [(25, None), (26, ([], [])), (27, ([99], [1.0])), (28, ([0], [1.0]))]
    left = spark.createDataFrame(proposals, f"proposal_id long, query_vec {SCHEMA}")
    right = spark.createDataFrame(tickets, f"pos long, vec {SCHEMA}").repartition(4)
    index = impact_index.build_index(right, block_rows=block_rows)
    found = impact_index.indexed_top_k(left, index, k, 0.2)
    assert {(r["proposal_id"], r["pos"], r["similarity"], r["rank"]) for r in found.rows.collect()} == slow(proposals, tickets, k, 0.2)
    assert index.blocks.agg(F.sum("size")).first()[0] == 602
    with pytest.raises(ValueError):
        impact_index.indexed_top_k(left, index, k, 0.0)


def test_empty_tables(spark):
    none_left = spark.createDataFrame([], f"proposal_id long, query_vec {SCHEMA}")
    none_right = spark.createDataFrame([], f"pos long, vec {SCHEMA}")
    found = impact_index.indexed_top_k(none_left, impact_index.build_index(none_right))
    assert found.rows.collect() == [] and found.work.collect() == []


def test_few_tickets_are_scored_and_plans_have_no_cross_join(spark):
    proposals, tickets, _ = tables.encoded(spark, SF)
    index = impact_index.build_index(tickets)
    found = impact_index.indexed_top_k(proposals, index)
    text = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    scored = found.work.agg(F.sum("scored")).first()[0] or 0
    every = proposals.count() * tickets.where("vec is not null").count()
    assert scored < every / 2, (scored, every)


def test_entries_are_not_grouped_to_find_the_heaviest(spark, monkeypatch):
    """One row per ticket is shuffled for the heads and the blocks, not one per entry; a block lies in one partition."""
    rng = random.Random(3)
    right = spark.createDataFrame([(i, vector(rng, 40, False)) for i in range(300)], f"pos long, vec {SCHEMA}").repartition(4)
    plans, plain = [], impact_index.materialise
    monkeypatch.setattr(impact_index, "materialise", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or plain(x))
    index = impact_index.build_index(right, block_rows=8)
    generated = [p for p in plans if "Generate" in p]
    # above the explode nothing is exchanged
    assert len(generated) == 1 and "Exchange" not in generated[0].split("Generate")[0]
    parts = index.postings.withColumn("part", F.spark_partition_id()).groupBy("block").agg(F.count_distinct("part").alias("n"))
    assert parts.where("n > 1").isEmpty()


def test_vectors_are_kept_instead_of_entries(spark, monkeypatch):
    """What an index writes per entry are bounds only; the postings of asked features are read from the vectors."""
    rng = random.Random(7)
    right = spark.createDataFrame([(i, vector(rng, 40, True)) for i in range(300)], f"pos long, vec {SCHEMA}").repartition(4)
    kept, plain = [], impact_index.materialise
    monkeypatch.setattr(impact_index, "materialise", lambda x: kept.append(plain(x)) or kept[-1])
    index = impact_index.build_index(right, block_rows=8)
    entries = index.postings.count()
    assert [df.count() for df in kept if "value" in df.columns] == []
    want = index.postings.groupBy("feature", "block").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    assert sorted(map(tuple, index.bounds.collect())) == sorted(map(tuple, want.collect())) and index.bounds.count() < entries
