"""Roles of the test tables: documents are tickets, benchmark items are proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.runs import word_runs
from feedlens.functions.text import embedding_text, match_key
from feedlens.operators.encode import TextEncoder, fit_text_encoder
from feedlens.plans.pipelines import encode_proposals, encode_tickets
from feedlens.session import materialise, spread

CRITERIA = ["Low", "Medium", "High", "Very High", "Critical"]
# shift of the criterion cycle, so that the five criteria of a proposal differ
OFFSETS = {"effort": 0, "impact": 1, "alignment": 2, "cost": 3, "risk": 4}
TEXT_GATE = 0.30
SCENARIO_LANGUAGES = ["en", "fr", "de", "es"]
VECTOR_THRESHOLD = 0.35


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("ticket_id"),
        F.col("lang").alias("topic"), F.col("text").alias("message"),
    )


def dates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("ts").alias("created_at"))


def criterion(id: Column, shift: int) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CRITERIA]), ((id + shift) % 5 + 1).cast("int"))


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("proposal_id"), F.col("text").alias("proposal"),
        F.split("text", " ").alias("keywords"),
        *[criterion(F.col("item_id"), shift).alias(name) for name, shift in OFFSETS.items()],
    )


def encoder(spark: SparkSession, sf: str) -> TextEncoder:
    rows = tickets(spark, sf)
    return fit_text_encoder(rows, embedding_text(F.col("topic"), F.col("message")))


def encoded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, TextEncoder]:
    """Proposals with ``query_vec``, tickets with ``vec``, and their encoder."""
    fitted = encoder(spark, sf)
    return encode_proposals(proposals(spark, sf), fitted), encode_tickets(tickets(spark, sf), fitted), fitted


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("ticket_id"),
        F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("label"),
    )


def annotated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled ticket pairs: each document with its successor, and each copy with the first of its text.

    A pair is a duplicate if both texts have the same exact-match key. The pair list grows
    linearly with the documents, also where one text has very many copies.
    """
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    docs = materialise(docs.select(F.col("doc_id").alias("d"), F.md5(match_key(F.col("text"))).alias("k")))
    following = docs.select((F.col("d") - 1).alias("d"), F.col("d").alias("e"), F.col("k").alias("ek"))
    neighbours = docs.join(following, "d").select(F.col("d").alias("a"), F.col("e").alias("b"), (F.col("k") == F.col("ek")).alias("dup"))
    first = docs.groupBy("k").agg(F.min("d").alias("a"))
    copies = docs.join(first, "k").where("a <> d").select("a", F.col("d").alias("b"), F.lit(True).alias("dup"))
    both = neighbours.unionByName(copies).groupBy("a", "b").agg(F.max("dup").alias("is_duplicate"))
    return both.select(F.col("a").cast("string").alias("ticket_a"), F.col("b").cast("string").alias("ticket_b"), "is_duplicate")


def passage_truth(spark: SparkSession, sf: str, width: int = 8) -> DataFrame:
    """``(query_id, ticket_id)``: a document is relevant to a benchmark item if they share ``width`` words in a row."""

    def runs(name: str, id: str, into: str) -> DataFrame:
        texts = spread(table(spark, sf, name)).select(F.col(id).alias(into), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        return texts.select(into, F.explode(word_runs("text", width)).alias("run"))

    shared = runs("documents", "doc_id", "ticket_id").join(runs("benchmark", "item_id", "query_id").distinct(), "run")
    return shared.select("query_id", F.col("ticket_id").cast("string").alias("ticket_id")).distinct()


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction per document; its score comes from the length of the text."""
    from feedlens.operators.score import confidence_tier

    value = F.col("n_chars") % 101
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("record_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("proposal"),
        value.alias("predicted_score"), confidence_tier(value).alias("predicted_confidence"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Two outcomes per labelled document, at the times of two events of its own; without one the time is unknown."""
    labels = table(spark, sf, "labels")
    events = table(spark, sf, "events").select("event_id", "ts")
    first = labels.select(F.col("doc_id").alias("record_id"), F.col("quality").cast("double").alias("actual_outcome"), F.col("doc_id").alias("event_id"))
    second = labels.select(F.col("doc_id").alias("record_id"), (1 - F.col("toxic")).cast("double").alias("actual_outcome"), (F.col("doc_id") * 5 + 3).alias("event_id"))
    return first.unionByName(second).join(events, "event_id", "left").select("record_id", "actual_outcome", "ts")
