"""Components of a table that grows by batches against one run over everything."""

import random

import pytest
from pyspark.sql import functions as F

from feedlens.functions.text import embedding_text
from feedlens.operators import dedup, dedup_store, pairs
from feedlens.operators.dedup_store import DedupStore
from feedlens.operators.encode import fit_text_encoder
from feedlens.session import work_folder


def chains(seed, n=120):
    """Texts that drift word by word, so that later tickets join groups of earlier ones; copies, blanks and case variants."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    heads = [[rng.choice(words) for _ in range(14)] for _ in range(8)]
    rows = []
    for i in range(n):
        head = rng.choice(heads)
        if rng.random() < 0.5:
            head[rng.randrange(14)] = rng.choice(words)
        text = " ".join(head)
        text = rng.choice([text, text, text.upper() + "!", "", None, "common " * 3 + rng.choice(words)])
        rows.append((i, "UI", text))
    return rows


def whole(spark, df, encoder):
    got = dedup.corpus_components(df, lambda v, t: pairs.sparse_pairs(v, encoder, t, forest=True), encode=lambda t: encoder.encode(t, embedding_text(F.col("topic"), F.col("message"))))
    return {r["pos"]: r["component"] for r in got.collect()}


def batched(spark, rows, encoder, cuts):
    store = DedupStore(spark, work_folder(spark, "dedup"), encoder)
    for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        store.add(spark.createDataFrame(rows[low:high], "pos long, topic string, message string"))
    return {r["pos"]: r["component"] for r in store.components().collect()}


@pytest.mark.parametrize("seed,cuts,hot", [(1, [60], 4096), (2, [20, 20, 90], 4096), (3, [50, 100], 3)])
def test_batches_give_the_components_of_one_run(spark, monkeypatch, seed, cuts, hot):
    rows = chains(seed)
    df = spark.createDataFrame(rows, "pos long, topic string, message string")
    encoder = fit_text_encoder(df, embedding_text(F.col("topic"), F.col("message")))
    monkeypatch.setattr(dedup_store.sparse_delta_pairs, "__defaults__", (hot, 16))
    want = whole(spark, df, encoder)
    assert len(set(want.values())) < len(rows) - 10
    assert batched(spark, rows, encoder, cuts) == want


def test_a_later_ticket_merges_stored_components(spark):
    a, b = "one two three four five six seven", "one two three four five six eight nine ten"
    rows = [(1, "t", a), (2, "t", "unrelated words entirely"), (3, "t", b), (4, "t", "One two THREE four five six seven!"), (5, "t", "one two three four five six seven eight"), (6, "t", "one two three four five six seven eight nine")]
    df = spark.createDataFrame(rows, "pos long, topic string, message string")
    encoder = fit_text_encoder(df, embedding_text(F.col("topic"), F.col("message")))
    store = DedupStore(spark, work_folder(spark, "dedup"), encoder, 0.8)
    seen = []
    for row in rows:
        store.add(spark.createDataFrame([row], "pos long, topic string, message string"))
        seen.append(dict(store.components().collect()))
    want = dedup.corpus_components(df, lambda v, t: pairs.sparse_pairs(v, encoder, t, forest=True), 0.8, encode=lambda t: encoder.encode(t, embedding_text(F.col("topic"), F.col("message"))))
    assert seen[-1] == {r["pos"]: r["component"] for r in want.collect()}
    assert seen[2][3] == 3 and seen[-1][3] == 1  # stored apart, then joined by a later ticket


def test_order_of_positions_and_broken_batches(spark):
    rows = [(5, "t", "some words here"), (6, "t", "some words here")]
    df = spark.createDataFrame(rows, "pos long, topic string, message string")
    encoder = fit_text_encoder(df, embedding_text(F.col("topic"), F.col("message")))
    store = DedupStore(spark, work_folder(spark, "dedup"), encoder)
    assert store.components().collect() == []
    store.add(df.limit(0))
    store.add(df)
    with pytest.raises(ValueError, match="lie behind"):
        store.add(spark.createDataFrame([(6, "t", "x")], df.schema))
    # a batch whose last table is missing doesn't count and is written again
    store._write("texts", spark.createDataFrame([("h", "k", 9, 9)], store.TABLES["texts"]), 2)
    assert dict(store.components().collect()) == {5: 5, 6: 5}
    store.add(spark.createDataFrame([(7, "t", "other text")], df.schema))
    assert dict(store.components().collect()) == {5: 5, 6: 5, 7: 7}
    with pytest.raises(ValueError):
        DedupStore(spark, "x", encoder, 0.0)
