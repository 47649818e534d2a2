"""Multi-criteria decision rules as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.constants import (
    ASSUMPTIONS, LOWEST_TIER, MISSING, PRIORITY_OFFSET, PRIORITY_TIERS, RATIONALE, RISKS, TRADE_OFFS, WEIGHTS,
)
from feedlens.functions.text import clip, fill, fixed, level, rescale, round_half_even

# criterion -> level taken where none can be read
DEFAULT_LEVELS = {"effort": 3.0, "impact": 3.0, "alignment": 3.0, "cost": 1.5, "risk": 1.5}


def priority_tier(priority: Column) -> Column:
    low, name = PRIORITY_TIERS[0]
    tier = F.when(priority >= low, name)
    for low, name in PRIORITY_TIERS[1:]:
        tier = tier.when(priority >= low, name)
    return tier.otherwise(LOWEST_TIER)


def _lines(*lines: tuple[Column | bool, str], default: str | None = None, **values: Column) -> Column:
    """The sentences whose condition holds, in order; the default one if there are none."""
    parts = [fill(text, **values) if when is True else F.when(when, fill(text, **values)) for when, text in lines]
    kept = F.array_compact(F.array(*parts))
    return kept if default is None else F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def decide(scored: DataFrame) -> DataFrame:
    """Decision columns for rows with ``evidence_score`` and the five criteria.

    Input: ``proposal_id, evidence_score, effort, impact, alignment, cost, risk`` and, where
    known, ``sample_size`` and ``duplicate_count``. A missing evidence score is an error.
    """
    has = set(scored.columns)
    given = F.col("evidence_score").cast("double")
    bad = F.raise_error(F.lit("evidence_score must be a numeric value")).cast("double")
    base = scored.select(
        "proposal_id",
        F.when(given.isNull() | F.isnan(given), bad).otherwise(clip(given, 0.0, 100.0)).alias("ev"),
        *[level(F.col(c), d).alias(c) for c, d in DEFAULT_LEVELS.items()],
        (F.col("sample_size") if "sample_size" in has else F.lit(None).cast("string")).alias("sample_size"),
        (F.col("duplicate_count") if "duplicate_count" in has else F.lit(0)).cast("bigint").alias("dup"),
    )
    ev, eff, imp, align, cost, risk = (F.col(c) for c in ("ev", "effort", "impact", "alignment", "cost", "risk"))
    gains = WEIGHTS["evidence"] * ev + WEIGHTS["impact"] * rescale(imp) + WEIGHTS["alignment"] * rescale(align)
    drags = WEIGHTS["effort"] * rescale(eff) + WEIGHTS["cost"] * rescale(cost) + WEIGHTS["risk"] * rescale(risk)
    base = base.withColumns({"gains": gains, "drags": drags})
    net = clip(F.col("gains") - F.col("drags") + PRIORITY_OFFSET, 0.0, 100.0)
    base = base.withColumn("priority_score", round_half_even(net, 0).cast("int"))

    pri = F.col("priority_score")
    shown = {
        "ev": fixed(ev, 0), "pri": pri, "imp": fixed(imp, 1), "eff": fixed(eff, 1),
        "risk": fixed(risk, 1), "cost": fixed(cost, 1), "dup": F.col("dup"),
    }

    def verdict(action: str, reasons: str) -> Column:
        lines = F.array(*[fill(t, **shown) for t in RATIONALE[reasons]])
        return F.struct(F.lit(action).alias("recommendation"), lines.alias("rationale"))

    # ordered, the first rule that holds decides
    ruling = (
        F.when(ev == 0, verdict("INSUFFICIENT_EVIDENCE", "none"))
        .when((risk >= 4.5) & (ev < 40) & (align <= 2.0), verdict("REJECT", "reject"))
        .when((imp >= 4.0) & (ev < 70), verdict("VALIDATE_FURTHER", "impact"))
        .when(
            (eff >= 4.0) & ((risk >= 3.5) | (cost >= 3.5)) & ev.between(40, 75), verdict("PROTOTYPE_OR_SPIKE", "spike")
        )
        .when((ev >= 70) & (pri >= 50) & (risk <= 4.0), verdict("PROCEED_TO_BUILD", "build"))
        .when((ev < 40) & (imp <= 3.0), verdict("DEPRIORITIZE", "modest"))
        .when((eff >= 4.0) & (align <= 2.5), verdict("DEPRIORITIZE", "misaligned"))
        .when(pri >= 60, verdict("PROCEED_TO_BUILD", "favorable"))
        .when(pri >= 40, verdict("VALIDATE_FURTHER", "borderline"))
        .otherwise(verdict("DEPRIORITIZE", "suboptimal"))
    )
    size_known_small = F.coalesce(F.col("sample_size").isin("Zero", "Small"), F.lit(False))
    balance = (
        F.when((imp >= 4.0) & (eff >= 4.0), TRADE_OFFS["both_high"])
        .when((imp >= 4.0) & (eff <= 2.0), TRADE_OFFS["quick_win"])
        .when((imp <= 2.0) & (eff >= 3.5), TRADE_OFFS["low_value"])
    )
    off_strategy = F.when((ev >= 70) & (align <= 2.5), TRADE_OFFS["off_strategy"])
    trades = F.array_compact(F.array(balance, off_strategy))
    return base.withColumn("ruling", ruling).select(
        "proposal_id",
        F.col("ruling.recommendation").alias("recommendation"),
        "priority_score",
        priority_tier(pri).alias("decision_tier"),
        round_half_even(ev, 0).cast("int").alias("evidence_score"),
        F.col("ruling.rationale").alias("rationale"),
        _lines(
            (True, ASSUMPTIONS["effort"]), (True, ASSUMPTIONS["impact"]),
            (F.col("dup") > 0, ASSUMPTIONS["duplicates"]), **shown,
        ).alias("assumptions"),
        _lines(
            (risk >= 3.5, RISKS["execution"]), (eff >= 4.0, RISKS["opportunity"]),
            (cost >= 3.5, RISKS["financial"]), (ev < 50, RISKS["market"]), default=RISKS["default"], **shown,
        ).alias("risks"),
        F.when(F.size(trades) == 0, F.array(F.lit(TRADE_OFFS["default"]))).otherwise(trades).alias("trade_offs"),
        _lines(
            (ev < 70, MISSING["analytics"]), (ev < 70, MISSING["interviews"]),
            (size_known_small, MISSING["sample"]), (True, MISSING["spec"]),
        ).alias("missing_information"),
        F.struct(
            round_half_even(ev, 1).alias("evidence_score"),
            eff.alias("engineering_effort_level"),
            imp.alias("business_impact_level"),
            align.alias("strategic_alignment_level"),
            cost.alias("cost_level"),
            risk.alias("risk_level"),
            round_half_even(F.col("gains"), 2).alias("raw_benefits"),
            round_half_even(F.col("drags"), 2).alias("raw_frictions"),
        ).alias("criteria_breakdown"),
    )
