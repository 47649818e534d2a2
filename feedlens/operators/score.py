"""Five-factor evidence score, one aggregate per proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.constants import SINGLE_TICKET_CAP, TWO_TICKET_CAP
from feedlens.functions.text import clip, is_severe, parse_time, round_half_even, strip

FACTORS = ["ticket_volume", "severity", "sentiment_consistency", "recency", "diversity"]


def confidence_tier(score: Column) -> Column:
    return F.when(score < 40, "Low").when(score < 70, "Moderate").otherwise("High")


def sample_size(n: Column) -> Column:
    return F.when(n == 0, "Zero").when(n <= 2, "Small").when(n < 6, "Medium").otherwise("Large")


def score_cap(n: Column) -> Column:
    return F.when(n == 1, SINGLE_TICKET_CAP).when(n == 2, TWO_TICKET_CAP).otherwise(100)


def factor_points(evidence: DataFrame, by: str = "proposal_id") -> DataFrame:
    """Unrounded factor points per proposal, except diversity which is rounded before it is summed.

    Columns that are missing follow the contract: no similarity counts as 1 for every ticket,
    no message scores 10 points of consistency, no date 10 of recency, no id counts as distinct.
    """
    has = set(evidence.columns)
    sim = clip(F.col("similarity").cast("double"), 0.0, 1.0) if "similarity" in has else F.lit(1.0)
    message = F.col("message") if "message" in has else F.lit(None).cast("string")
    dated = parse_time(F.col("created_at")).isNotNull() if "created_at" in has else F.lit(False)
    tickets = evidence.select(
        by,
        sim.alias("s"),
        F.length(strip(message)).alias("chars"),
        F.when(is_severe(message), sim).alias("severe"),
        dated.alias("dated"),
        (F.col("ticket_id").cast("string") if "ticket_id" in has else F.lit(None).cast("string")).alias("ticket"),
    )
    # one pre-aggregation per ticket id keeps the distinct count cheap and free of hot groups
    per_ticket = tickets.groupBy(by, "ticket").agg(
        F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("chars").alias("chars"),
        F.sum("severe").alias("severe"), F.max("dated").alias("dated"),
    )
    totals = per_ticket.groupBy(by).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("chars").alias("chars"),
        F.coalesce(F.sum("severe"), F.lit(0.0)).alias("severe"), F.max("dated").alias("dated"),
        F.count("ticket").alias("tickets"),
    )
    mean = F.col("s") / F.col("n")
    chars = F.col("chars") / F.col("n")
    detail = F.when(chars >= 30, 25.0).when(chars >= 15, 18.0).otherwise(10.0)
    distinct = F.col("tickets") if "ticket_id" in has else F.col("n")
    return totals.select(
        by,
        "n",
        mean.alias("mean_similarity"),
        F.least(F.lit(30.0), F.col("s") * 6.0).alias("ticket_volume"),
        F.least(F.lit(20.0), F.col("severe") * 4.0).alias("severity"),
        (detail * mean).alias("sentiment_consistency"),
        (F.when(F.col("dated"), 15.0).otherwise(10.0) * mean).alias("recency"),
        round_half_even(distinct / F.col("n") * 10.0 * mean, 1).alias("diversity"),
    )


def score_evidence(proposals: DataFrame, evidence: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """``(proposal_id, score, confidence, evidence_summary, factors)`` for every proposal.

    ``retrieved`` is ``(proposal_id, retrieved)``, the tickets found before the gate; without
    it the validated count is taken. Proposals without evidence score 0.
    """
    joined = proposals.select("proposal_id").join(factor_points(evidence), "proposal_id", "left")
    if retrieved is not None:
        joined = joined.join(retrieved.select("proposal_id", "retrieved"), "proposal_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    found = F.coalesce(F.col("retrieved"), n) if retrieved is not None else n
    points = {f: F.coalesce(F.col(f), F.lit(0.0)) for f in FACTORS}
    total = round_half_even(sum(points[f] for f in ("ticket_volume", "sentiment_consistency", "severity", "recency", "diversity")), 0)
    score = F.greatest(F.lit(0), F.least(total.cast("int"), score_cap(n)))
    return joined.select(
        "proposal_id",
        score.cast("int").alias("score"),
        confidence_tier(score).alias("confidence"),
        F.struct(
            n.alias("validated_tickets"),
            found.cast("bigint").alias("retrieved_tickets"),
            F.greatest(F.lit(0).cast("bigint"), found - n).alias("rejected_tickets"),
            round_half_even(F.coalesce(F.col("mean_similarity"), F.lit(0.0)), 2).alias("average_similarity"),
            sample_size(n).alias("sample_size"),
        ).alias("evidence_summary"),
        F.struct(*[round_half_even(points[f], 1).alias(f) for f in FACTORS]).alias("factors"),
    )
