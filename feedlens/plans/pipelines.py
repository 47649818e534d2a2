"""User-level jobs: evidence memos, decision memos and the evaluation audit, for many proposals at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.constants import (
    CLUSTER_DISTANCE, CLUSTER_SWEEP, DEDUP_SWEEP, DEDUP_THRESHOLD, EVIDENCE_THRESHOLD, RETRIEVAL_THRESHOLD, TOP_K,
)
from feedlens.functions import vectors as V
from feedlens.functions.text import embedding_text, query_text, round_half_even
from feedlens.operators import calibrate, cluster, components, decide, dedup, evaluate, merge_forest, prompt, retrieve, score
from feedlens.operators.encode import TextEncoder
from feedlens.session import materialise

#: Tickets retrieved per query for the sweep over gates.
SWEEP_TOP_K = 10


@dataclass
class EvidenceRun:
    evidence: DataFrame
    validated: DataFrame
    scores: DataFrame
    prompts: DataFrame


@dataclass
class DecisionRun:
    evidence: DataFrame
    members: DataFrame
    groups: DataFrame
    dedup_stats: DataFrame
    clustered: DataFrame
    clusters: DataFrame
    cluster_stats: DataFrame
    scores: DataFrame
    decisions: DataFrame
    prompts: DataFrame


@dataclass
class EvaluationRun:
    """Metric tables of one evaluation."""

    per_query: DataFrame
    retrieval: DataFrame
    negative_controls: DataFrame
    confusion: DataFrame
    error_causes: DataFrame
    candidate_filters: DataFrame
    gate_sweep: DataFrame
    dedup_sweep: DataFrame
    cluster_sweep: DataFrame
    corpus_cluster_sweep: DataFrame


def encode_tickets(tickets: DataFrame, encoder: TextEncoder) -> DataFrame:
    return encoder.encode(tickets, embedding_text(F.col("topic"), F.col("message")))


def encode_proposals(proposals: DataFrame, encoder: TextEncoder) -> DataFrame:
    """``query_vec`` of the joined keywords; a proposal without any usable keyword finds nothing."""
    return encoder.encode(proposals, query_text(F.col("keywords")), "query_vec")


def find_evidence(
    proposals: DataFrame, tickets: DataFrame, k: int = TOP_K, threshold: float = RETRIEVAL_THRESHOLD,
    dates: DataFrame | None = None, within: str | None = None,
) -> DataFrame:
    """Top-k evidence, written once so that every later step starts from k rows per proposal.

    ``dates`` is ``(pos, created_at)`` where dates live in another table: they are joined to
    the evidence, not to the tickets, so ticket texts are never shuffled for them.
    """
    found = retrieve.retrieve(proposals, tickets, k, threshold, within=within)
    if dates is not None:
        found = found.join(dates, "pos", "left")
    return materialise(found)


def _given(validated: DataFrame) -> DataFrame:
    """Tickets handed in as already validated: ranked by position, similarity unknown."""
    by_position = Window.partitionBy("proposal_id").orderBy("pos")
    return materialise(validated.withColumn("rank", F.row_number().over(by_position)))


def evidence_pipeline(
    proposals: DataFrame, tickets: DataFrame | None = None, k: int = TOP_K,
    retrieval_threshold: float = RETRIEVAL_THRESHOLD, evidence_threshold: float = EVIDENCE_THRESHOLD,
    dates: DataFrame | None = None, validated: DataFrame | None = None, template: str = prompt.EVIDENCE_TEMPLATE,
    within: str | None = None,
) -> EvidenceRun:
    """Retrieve, gate, score and write the evidence prompt; ``validated`` tickets bypass retrieval."""
    if validated is None:
        evidence = find_evidence(proposals, tickets, k, retrieval_threshold, dates, within)
        kept = retrieve.gate(evidence, evidence_threshold)
        counts = retrieve.gate_counts(proposals, evidence, evidence_threshold)
    else:
        evidence = kept = _given(validated)
        counts = None
    scores = score.score_evidence(proposals, kept, counts)
    return EvidenceRun(evidence, kept, scores, prompt.evidence_prompts(proposals, scores, kept, template))


def decision_pipeline(
    proposals: DataFrame, tickets: DataFrame | None = None, k: int = TOP_K,
    retrieval_threshold: float = RETRIEVAL_THRESHOLD, evidence_threshold: float = EVIDENCE_THRESHOLD,
    dedup_threshold: float = DEDUP_THRESHOLD, distance: float = CLUSTER_DISTANCE, strategy: str = "longest",
    dates: DataFrame | None = None, validated: DataFrame | None = None, template: str = prompt.DECISION_TEMPLATE,
    within: str | None = None,
) -> DecisionRun:
    """Retrieve, gate, deduplicate, cluster, score, decide and write the decision prompt.

    ``proposals`` is ``proposal_id, proposal, effort, impact, alignment, cost, risk`` with
    ``query_vec``; ``tickets`` is ``pos, ticket_id, topic, message`` with ``vec``. With ``within``, a
    text column of both, proposals of many datasets run in one job and each meets its own dataset alone.
    """
    if validated is None:
        evidence = find_evidence(proposals, tickets, k, retrieval_threshold, dates, within)
        kept = retrieve.gate(evidence, evidence_threshold)
        counts = retrieve.gate_counts(proposals, evidence, evidence_threshold)
    else:
        evidence = kept = _given(validated)
        counts = kept.groupBy("proposal_id").agg(F.count("*").alias("retrieved"))
    by = ("proposal_id",)
    members = materialise(dedup.choose_representatives(dedup.group_components(kept, dedup_threshold), strategy, by, "rank"))
    stats = dedup.dedup_stats(members, by, proposals)
    unique = dedup.representatives(members)
    labels = cluster.cluster_groups(unique, distance).drop("cut")
    clustered = materialise(unique.join(labels, ["proposal_id", "rank"]))
    clusters = cluster.cluster_table(clustered)
    cluster_stats = cluster.cluster_stats(clusters, by, proposals)
    scores = score.score_evidence(proposals, clustered, counts)
    criteria = proposals.select("proposal_id", *decide.DEFAULT_LEVELS)
    ready = scores.select(
        "proposal_id", F.col("score").alias("evidence_score"), F.col("evidence_summary.sample_size").alias("sample_size")
    )
    ready = ready.join(criteria, "proposal_id").join(stats.select("proposal_id", "duplicate_count"), "proposal_id")
    decisions = decide.decide(ready)
    prompts = prompt.decision_prompts(proposals, decisions, scores, clustered, stats, cluster_stats, clusters, template)
    groups = dedup.duplicate_groups(members, by, "rank", with_ids=True)
    return DecisionRun(evidence, members, groups, stats, clustered, clusters, cluster_stats, scores, decisions, prompts)


def log_predictions(run: DecisionRun, proposals: DataFrame, path: str) -> None:
    """Append one prediction per decision to the calibration log."""
    calibrate.append(calibrate.new_predictions(proposals, run.decisions, run.scores), path)


def cluster_counts(cuts: DataFrame, by: str = "proposal_id") -> DataFrame:
    """Number, mean size and mean cohesion of the clusters at each cut of ``cluster_groups``."""
    per_cluster = cuts.groupBy("cut", by, "cluster_id").agg(F.count("*").alias("size"), F.first("cohesion").alias("cohesion"))
    return per_cluster.groupBy(F.col("cut").alias("distance_threshold")).agg(
        F.count("*").alias("total_clusters"), round_half_even(F.avg("size"), 2).alias("average_cluster_size"),
        round_half_even(F.avg("cohesion"), 4).alias("intra_cluster_coherence"),
    )


def evaluation_job(
    queries: DataFrame, truth: DataFrame, tickets: DataFrame, pairs: DataFrame, encoder: TextEncoder, edges_of,
    within: str | None = None, k: int = 5, gates: list[float] | None = None, gate: float = EVIDENCE_THRESHOLD,
    dedup_thresholds: list[float] | None = None, dedup_threshold: float = DEDUP_THRESHOLD, cuts: list[float] | None = None,
    corpus_cuts: list[float] | None = None,
) -> EvaluationRun:
    """All metric tables of labelled data, from one encode, one retrieval and one similarity join.

    ``queries`` is ``query_id, keywords`` (and ``within``), ``truth`` the relevant ``query_id,
    ticket_id``, ``tickets`` is ``pos, ticket_id, topic, message`` (and ``within``), ``pairs`` the labelled
    ``ticket_a, ticket_b, is_duplicate``; ``edges_of(vectors, threshold)`` gives similarity edges
    ``a, b, similarity``. Queries without relevant tickets are the negative controls.

    Tickets are retrieved at the default threshold, ``SWEEP_TOP_K`` of them for the gates; the metrics per
    query look at the first ``k``. ``cluster_sweep`` cuts the evidence of each query,
    ``corpus_cluster_sweep`` one merge forest of all tickets.
    """
    dedup_thresholds, cuts = dedup_thresholds or list(DEDUP_SWEEP), cuts or list(CLUSTER_SWEEP)
    gates = gates or [0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80]
    encoded = materialise(encode_tickets(tickets, encoder))
    asked = encode_proposals(queries.withColumnRenamed("query_id", "proposal_id"), encoder)
    found = materialise(retrieve.retrieve(asked, encoded, max(k, SWEEP_TOP_K), RETRIEVAL_THRESHOLD, within=within))
    ranked = found.withColumnRenamed("proposal_id", "query_id").select("query_id", "rank", "similarity", "ticket_id")
    hits = evaluate.mark_hits(ranked, truth)
    totals = materialise(evaluate.relevant_counts(queries.select("query_id"), truth))
    per_query = evaluate.ir_metrics(totals, hits, k)

    keyed = dedup.exact_components(encoded.drop("vec")).select("pos", "ticket_id", "key", "chars", "component")
    keyed = materialise(keyed)
    text = F.md5(embedding_text(F.col("topic"), F.col("message")))
    first = encoded.groupBy(text).agg(F.min("pos").alias("pos")).select("pos")
    alike = edges_of(encoded.select("pos", "vec").join(first, "pos", "left_semi"), min([*dedup_thresholds, dedup_threshold]))
    exact = keyed.where("component <> pos").select(F.col("component").alias("a"), F.col("pos").alias("b"), F.lit(1.0).alias("similarity"))
    edges = materialise(exact.unionByName(alike.select("a", "b", "similarity")))
    parts = components.connected_components(edges.where(F.col("similarity") >= dedup_threshold).select("a", "b"))
    members = keyed.drop("component").join(parts, F.col("pos") == F.col("node"), "left").withColumn("component", F.coalesce("component", "pos")).drop("node")
    members = materialise(dedup.choose_representatives(members))
    judged = materialise(evaluate.predict_duplicates(pairs, members))
    compared = evaluate.annotate_pairs(judged, encoded, ["topic", "message", "vec"])
    vectors = encoded.where("vec is not null").select("pos", "vec")
    corpus_cuts = corpus_cuts or list(CLUSTER_SWEEP)
    forest = merge_forest.merge_forest(vectors, edges_of, max(corpus_cuts))
    wrong = compared.where("is_duplicate <> predicted").withColumn("similarity", V.pair_similarity("vec_a", "vec_b"))
    return EvaluationRun(
        per_query=per_query, retrieval=evaluate.ir_macro(per_query),
        negative_controls=evaluate.negative_controls(totals.where("total_relevant = 0"), ranked.where(F.col("rank") <= k), gate),
        confusion=evaluate.confusion(judged), error_causes=evaluate.error_causes(wrong, dedup_threshold),
        candidate_filters=evaluate.candidate_filters(evaluate.pair_features(compared)),
        gate_sweep=evaluate.gate_sweep(evaluate.gate_sweep_queries(totals, hits, gates)),
        dedup_sweep=evaluate.dedup_sweep(pairs, keyed.drop("component"), edges, dedup_thresholds),
        cluster_sweep=cluster_counts(cluster.cluster_groups(found, cuts)),
        corpus_cluster_sweep=merge_forest.sweep_table(vectors, forest, corpus_cuts),
    )
