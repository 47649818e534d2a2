"""The dense encoder against an exact singular value decomposition, and the comparison of encoders."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlens.functions.runs import word_runs
from feedlens.functions.text import match_key, words
from feedlens.operators import dense_encoder, encode, evaluate

WORDS = "login password reset fails crash battery drain dark mode theme search filter slow page export csv invoice payment refund card".split()


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    topics = [WORDS[i : i + 5] for i in range(0, len(WORDS), 4)]
    return [" ".join(rng.choice(topics[k % len(topics)], 6).tolist() + rng.choice(WORDS, 2).tolist()) for k in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "pos long, text string").repartition(parts)


def dense_rows(spark, rows, features):
    """TF-IDF rows of the base encoder as a matrix."""
    base = encode.fit_text_encoder(frame(spark, rows), "text", features)
    out = np.zeros((len(rows), features))
    for r in base.encode(frame(spark, rows), "text").collect():
        if r["vec"]:
            out[r["pos"], r["vec"]["idx"]] = r["vec"]["w"]
    return out


def encoded(spark, encoder, rows):
    return {r["pos"]: r["vec"] for r in encoder.encode(frame(spark, rows), "text").collect()}


def test_equals_exact_svd_where_the_block_covers_the_rank(spark):
    rows = texts(60) + [None, "", "?!"]
    fitted = dense_encoder.fit_dense_encoder(frame(spark, rows), "text", 6, 20, num_features=1 << 12)
    exact = dense_rows(spark, rows, 1 << 12)
    _, s, vt = np.linalg.svd(exact, full_matrices=False)
    assert np.allclose(fitted.singular, s[:6], rtol=1e-5)
    want = exact @ vt[:6].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = encoded(spark, fitted, rows)
    assert got[60] is None and got[61] is None and got[62] is None
    found = np.array([got[i] for i in range(60)])
    assert np.allclose(found @ found.T, want[:60] @ want[:60].T, atol=1e-4)


def test_rounds_sharpen_a_block_below_the_rank_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [" ".join(f"w{x}" for x in rng.zipf(1.6, 30) % 400) for _ in range(150)]
    _, s, vt = np.linalg.svd(dense_rows(spark, rows, 1 << 12), full_matrices=False)
    one, three, split = (
        dense_encoder.fit_dense_encoder(frame(spark, rows, parts), "text", 5, 5, rounds, 1 << 12) for rounds, parts in ((1, 2), (5, 2), (5, 40))
    )
    error = [np.abs(e.singular / s[:5] - 1).max() for e in (one, three)]
    assert error[1] < 5e-3 and error[1] < error[0]
    assert np.allclose(split.singular, three.singular, rtol=1e-6)
    a, b = (np.array([v for _, v in sorted(encoded(spark, e, rows).items())]) for e in (three, split))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-4)


@pytest.mark.parametrize("rows", [[], [None, "", "  "], ["one two"], ["same words"] * 5])
def test_few_or_no_texts(spark, rows):
    fitted = dense_encoder.fit_dense_encoder(frame(spark, rows) if rows else frame(spark, ["x"]).limit(0), "text", 4, 2, num_features=256)
    got = encoded(spark, fitted, [*rows, "one two", "unknown"])
    lengths = [np.linalg.norm(v) for v in got.values() if v is not None]
    assert np.allclose(lengths, 1.0) and (len(lengths) > 0) == any(r and r.strip() for r in rows)


def test_encoders_answer_the_same_queries(spark):
    rows = texts(80, 5)
    tickets = frame(spark, rows).select("pos", F.col("pos").cast("string").alias("ticket_id"), F.lit("t").alias("topic"), F.col("text").alias("message"))
    asked = spark.createDataFrame([(q, WORDS[i : i + 4]) for q, i in enumerate((0, 4, 8))] + [(3, ["nothing"])], "proposal_id long, keywords array<string>")
    truth = [(q, str(i)) for q in range(3) for i in range(q, 80, 5)]
    truth_df = spark.createDataFrame(truth, "query_id long, ticket_id string")
    text = evaluate.embedding_text(F.col("topic"), F.col("message"))
    encoders = {"tfidf": encode.fit_text_encoder(tickets, text), "svd": dense_encoder.fit_dense_encoder(tickets, text, 5, 25, num_features=1 << 12)}
    queries = evaluate.relevant_counts(asked.select(F.col("proposal_id").alias("query_id")), truth_df)
    got = {r["encoder"]: r.asDict() for r in evaluate.compare_encoders(queries, truth_df, asked, tickets, encoders).collect()}
    whole = [f"Topic: t | Message: {t}" for t in rows]
    for name, features in (("tfidf", encode.NUM_FEATURES), ("svd", 1 << 12)):
        vectors = {r["pos"]: r["vec"] for r in encoders[name].encode(frame(spark, whole), "text").collect()}
        found = {r["pos"]: r["vec"] for r in encoders[name].encode(frame(spark, [" ".join(WORDS[i : i + 4]) for i in (0, 4, 8)]), "text").collect()}

        def similarity(a, b):
            if name == "svd":
                return float(np.dot(a, b))
            weight = dict(zip(b["idx"], b["w"], strict=True))
            return sum(w * weight.get(i, 0.0) for i, w in zip(a["idx"], a["w"], strict=True))

        rates = []
        for q in range(3):
            scored = sorted(((round(similarity(found[q], vectors[p]), 9), p) for p in vectors), reverse=True)
            top = [str(p) for s, p in scored[:5] if s >= 0]
            hits = [(q, t) in truth for t in top]
            rates.append((sum(hits) / 5, sum(hits) / 16, next((1 / (n + 1) for n, h in enumerate(hits) if h), 0.0), sum(sum(hits[: n + 1]) / (n + 1) for n, h in enumerate(hits) if h) / 5))
        assert got[name]["queries_evaluated"] == 3
        want = np.mean(rates, axis=0)
        assert np.allclose([got[name][c] for c in ("precision_at_k", "recall_at_k", "mrr", "map")], want, atol=6e-5)


ODD_TEXTS = [
    "", None, "plain words, plain_words 2x", "d\u00e9j\u00e0 vu \u00ab\u00e9t\u00e9\u00bb 3\u00b2 \u00bd \u00d7 \u00f7 \u0130I\u0131", "it\u2019s \u2014 so\u2026", "\u4f60\u597d, \u043c\u0438\u0440 \u0663", "a\u0301b \U0001d7d8\U0001f600z",
    *("x" * n + " y" + "\u00e9" * n for n in (1, 27, 28, 54, 55, 56, 64, 200)), "".join(chr(c) + "q" for c in range(1, 0x260)), "".join("q" + chr(c) for c in range(0x2000, 0x2070)),
]


def test_features_are_the_digests_of_the_words(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "pos int, text string").coalesce(1)
    plain, odd = encode.spelled(F.coalesce("text", F.lit("")))
    rows = df.select(plain.alias("plain"), odd.alias("odd"), words(F.coalesce("text", F.lit(""))).alias("words")).toArrow().combine_chunks()
    want = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1000 for w in found] for found in rows.column("words").to_pylist()]
    assert 0 < rows.column("odd").null_count < len(want)
    for start in (0, 2):
        part = rows.slice(start)
        offsets, found = encode.features(part.column("plain").combine_chunks(), part.column("odd").combine_chunks(), 1000)
        assert [found[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[start:]
    offsets, found = encode.features(pa.array([], pa.string()), pa.array([], pa.list_(pa.string())))
    assert offsets.tolist() == [0] and not len(found)


def test_a_round_of_the_dense_fit_reads_the_rows_once(spark, monkeypatch):
    passes = []
    tree = dense_encoder._tree
    monkeypatch.setattr(dense_encoder, "_tree", lambda *a: passes.append(1) or tree(*a))
    dense_encoder.fit_dense_encoder(frame(spark, texts(40)), "text", 4, 6, 3, 1 << 10)
    assert len(passes) == 3


def test_runs_of_words_meet_as_the_words_do(spark):
    rng = np.random.default_rng(2)
    signs = ["a", "b", "B,", "c'c", "-", "\u00e9", "x.", "longer" * 12]
    gaps = [" ", "  ", "\t", "\u00a0", "\u2003", "\x1c", "\n", "\u3000", "\x85"]
    rows = ["".join(rng.choice(signs) + rng.choice(gaps) for _ in range(rng.integers(0, 14))) for _ in range(60)] + [None, "", "a b c"]
    df = spark.createDataFrame(list(enumerate(rows)), "pos int, text string")
    got = df.select("pos", F.split(match_key(F.col("text")), " ").alias("w"), word_runs(F.lower("text"), 3).alias("runs")).collect()
    seen: dict = {}
    for r in got:
        want = {tuple(r["w"][i : i + 3]) for i in range(len(r["w"]) - 2)}
        assert len(r["runs"]) == len(want)
        for i in range(len(r["w"]) - 2):
            seen.setdefault(tuple(r["w"][i : i + 3]), []).append(set(r["runs"]))
    assert all(set.intersection(*found) for found in seen.values())
    every = {x for r in got for x in r["runs"]}
    assert len(every) == len(seen)
