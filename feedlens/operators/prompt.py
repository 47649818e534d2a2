"""Prompt texts as string columns, one prompt per proposal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import bullets, fill, fixed, require_text

# --- fixed output formats ---------------------------------------------------
NO_TICKETS = "No tickets found matching the keyword criteria."
TICKET = "Ticket ID: {id}{tag}\nTopic: {topic}\nMessage: {message}\n---"
SCORING = (
    "Confidence Level: {confidence}\n"
    "Evidence Score: {score} / 100\n"
    "Evidence Telemetry:\n"
    "- Validated Tickets: {validated}\n"
    "- Retrieved Candidates: {retrieved}\n"
    "- Rejected Candidates: {rejected}\n"
    "- Average Similarity: {similarity}\n"
    "- Sample Size Tier: {size}\n"
    "Factor Breakdown:\n"
    "- Ticket Volume: {volume} / 30 pts\n"
    "- Severity & Urgency: {severity} / 20 pts\n"
    "- Sentiment Consistency: {consistency} / 25 pts\n"
    "- Recency: {recency} / 15 pts\n"
    "- User Diversity: {diversity} / 10 pts"
)
DECISION = (
    "Recommendation: {recommendation}\n"
    "Priority Score: {priority} / 100 ({tier})\n"
    "Evidence Score: {score} / 100\n"
    "Multi-Criteria Breakdown:\n"
    "- Engineering Effort: {effort}/5.0\n"
    "- Business Impact: {impact}/5.0\n"
    "- Strategic Alignment: {alignment}/5.0\n"
    "- Cost: {cost}/5.0\n"
    "- Risk: {risk}/5.0"
)
DEDUPLICATION = (
    "\nDeduplication Telemetry:\n"
    "- Total Raw Tickets: {total}\n"
    "- Unique Retained Tickets: {unique}\n"
    "- Duplicates Removed: {removed} ({rate}%)\n"
    "  * Exact Duplicates: {exact}\n"
    "  * Semantic Duplicates: {semantic}"
)
CLUSTERING = (
    "\nClustering & Theme Analysis:\n"
    "- Total Theme Clusters: {clusters}\n"
    "- Average Cluster Size: {mean} tickets"
)
CLUSTER_LINE = "  * [Cluster {id}] (Size: {size}, Cohesion: {cohesion}) - {label}"
TOP_CLUSTERS = 5

# --- our own default templates; a caller may pass the text of any other ------
EVIDENCE_TEMPLATE = """You explain how well customer tickets support a proposal. The score below is final; describe it, do not recompute it.

Proposal:
{proposal}

Score:
{scoring_summary}

Tickets:
{tickets_text}

Write four short sections: Confidence, Evidence, Missing, Recommendation. A proposal without tickets is undecided, never refuted.
"""
DECISION_TEMPLATE = """You write a decision memo. The recommendation and all scores below are final; explain them, do not change them.

Proposal:
{proposal}

Decision:
{decision_summary}

Evidence:
{evidence_summary}

Tickets:
{tickets_text}

Rationale:
{rationale_text}

Assumptions:
{assumptions_text}

Risks:
{risks_text}

Trade-offs:
{trade_offs_text}

Missing information:
{missing_info_text}

Cover each of these points in its own section and quote ticket ids. A lack of tickets alone is no reason to reject.
"""


def render(template: str, **values: Column) -> Column:
    """Substitute ``{name}`` placeholders; a placeholder without a value is an error at plan time."""
    unknown = set(re.findall(r"\{([A-Za-z_]\w*)\}", template)) - set(values)
    if unknown:
        raise KeyError(f"Template is missing required placeholder: {sorted(unknown)}")
    return fill(template, **{n: F.coalesce(c.cast("string"), F.lit("")) for n, c in values.items()})


def ticket_blocks(tickets: DataFrame, by: str = "proposal_id", order: str = "rank") -> DataFrame:
    """``(by, tickets_text)`` for the bounded top-k groups, in order, with a cluster tag if there is one."""
    tag = F.concat(F.lit(" [Cluster "), F.col("cluster_id").cast("string"), F.lit("]"))
    block = render(
        TICKET,
        id=F.col("ticket_id"),
        tag=tag if "cluster_id" in tickets.columns else F.lit(""),
        topic=F.coalesce("topic", F.lit("N/A")),
        message=F.coalesce("message", F.lit("N/A")),
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return tickets.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n").alias("tickets_text"))


def scoring_summary() -> Column:
    """Text of ``score, confidence, evidence_summary, factors``."""
    return render(
        SCORING,
        confidence=F.col("confidence"),
        score=F.col("score"),
        validated=F.col("evidence_summary.validated_tickets"),
        retrieved=F.col("evidence_summary.retrieved_tickets"),
        rejected=F.col("evidence_summary.rejected_tickets"),
        similarity=fixed(F.col("evidence_summary.average_similarity"), 2),
        size=F.col("evidence_summary.sample_size"),
        volume=F.col("factors.ticket_volume"),
        severity=F.col("factors.severity"),
        consistency=F.col("factors.sentiment_consistency"),
        recency=F.col("factors.recency"),
        diversity=F.col("factors.diversity"),
    )


def decision_summary() -> Column:
    parts = F.col("criteria_breakdown")
    return render(
        DECISION,
        recommendation=F.col("recommendation"),
        priority=F.col("priority_score"),
        tier=F.col("decision_tier"),
        score=F.col("evidence_score"),
        effort=parts["engineering_effort_level"],
        impact=parts["business_impact_level"],
        alignment=parts["strategic_alignment_level"],
        cost=parts["cost_level"],
        risk=parts["risk_level"],
    )


def top_clusters(clusters: DataFrame, by: str = "proposal_id") -> DataFrame:
    """``(by, cluster_lines)``: the largest clusters of each proposal, by size, then by label."""
    line = render(
        CLUSTER_LINE,
        id=F.col("cluster_id"), size=F.col("size"),
        cohesion=fixed(F.col("intra_cluster_similarity"), 2), label=F.col("theme_label"),
    )
    key = F.struct((-F.col("size")).alias("s"), F.col("cluster_id").alias("c"), line.alias("line"))
    first = F.slice(F.sort_array(F.collect_list(key)), 1, TOP_CLUSTERS)
    return clusters.groupBy(by).agg(F.transform(first, lambda x: x["line"]).alias("cluster_lines"))


def evidence_intelligence(with_dedup: bool, with_clusters: bool) -> Column:
    """Scoring summary, then deduplication and cluster telemetry where the columns are present."""
    parts = [scoring_summary()]
    if with_dedup:
        parts.append(render(
            DEDUPLICATION,
            total=F.col("total_input_count"), unique=F.col("unique_count"), removed=F.col("duplicate_count"),
            rate=fixed(F.col("duplicate_rate") * 100, 1),
            exact=F.col("exact_duplicates_count"), semantic=F.col("semantic_duplicates_count"),
        ))
    if with_clusters:
        head = render(CLUSTERING, clusters=F.col("total_clusters"), mean=fixed(F.col("average_cluster_size"), 1))
        parts.append(head)
        # null for no clusters, which concat_ws leaves out
        parts.append(F.nullif(F.array_join("cluster_lines", "\n"), F.lit("")))
    return F.concat_ws("\n", *parts)


def evidence_prompts(
    proposals: DataFrame, scores: DataFrame, tickets: DataFrame, template: str = EVIDENCE_TEMPLATE
) -> DataFrame:
    """``(proposal_id, prompt)`` of the evidence memo."""
    joined = proposals.select("proposal_id", "proposal").join(scores, "proposal_id")
    joined = joined.join(ticket_blocks(tickets), "proposal_id", "left")
    prompt = render(
        template,
        proposal=require_text(F.col("proposal"), "proposal"),
        scoring_summary=scoring_summary(),
        tickets_text=F.coalesce("tickets_text", F.lit(NO_TICKETS)),
    )
    return joined.select("proposal_id", prompt.alias("prompt"))


def decision_prompts(
    proposals: DataFrame,
    decisions: DataFrame,
    scores: DataFrame,
    tickets: DataFrame,
    dedup: DataFrame | None = None,
    cluster_stats: DataFrame | None = None,
    clusters: DataFrame | None = None,
    template: str = DECISION_TEMPLATE,
) -> DataFrame:
    """``(proposal_id, prompt)`` of the decision memo. Joins are one to one on the proposal."""
    joined = proposals.select("proposal_id", "proposal").join(scores, "proposal_id").join(decisions, "proposal_id")
    joined = joined.join(ticket_blocks(tickets), "proposal_id", "left")
    if dedup is not None:
        joined = joined.join(dedup, "proposal_id", "left")
    if cluster_stats is not None:
        joined = joined.join(cluster_stats, "proposal_id", "left")
        joined = joined.join(top_clusters(clusters), "proposal_id", "left")
    prompt = render(
        template,
        proposal=require_text(F.col("proposal"), "proposal"),
        decision_summary=decision_summary(),
        evidence_summary=evidence_intelligence(dedup is not None, cluster_stats is not None),
        tickets_text=F.coalesce("tickets_text", F.lit(NO_TICKETS)),
        rationale_text=bullets(F.col("rationale")),
        assumptions_text=bullets(F.col("assumptions")),
        risks_text=bullets(F.col("risks")),
        trade_offs_text=bullets(F.col("trade_offs")),
        missing_info_text=bullets(F.col("missing_information")),
    )
    return joined.select("proposal_id", prompt.alias("prompt"))
