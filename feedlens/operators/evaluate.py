"""Quality metrics over labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.constants import CANDIDATE_FILTERS, EVIDENCE_THRESHOLD, GENERIC_WORDS, WS
from feedlens.functions.text import embedding_text, ngram_jaccard, query_text, round_half_even, same_topic, strip, token_jaccard
from feedlens.functions.vectors import pair_similarity
from feedlens.operators.cluster import cohesion
from feedlens.operators.components import connected_components
from feedlens.operators.dedup import choose_representatives
from feedlens.operators.number import number_rows
from feedlens.operators.retrieve import retrieve

# --- retrieval ---------------------------------------------------------------


def mark_hits(ranked: DataFrame, truth: DataFrame, query: str = "query_id") -> DataFrame:
    """Ranked tickets with ``hit``; ``truth`` is one row per relevant (query, ticket)."""
    relevant = truth.select(query, "ticket_id").distinct().withColumn("hit", F.lit(True))
    return ranked.join(relevant, [query, "ticket_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def relevant_counts(queries: DataFrame, truth: DataFrame, query: str = "query_id") -> DataFrame:
    counts = truth.groupBy(query).agg(F.count_distinct("ticket_id").alias("total_relevant"))
    return queries.join(counts, query, "left").withColumn("total_relevant", F.coalesce("total_relevant", F.lit(0)))


def ir_metrics(queries: DataFrame, hits: DataFrame, k: int = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Precision@k, recall@k, reciprocal rank and average precision of every query with relevant tickets.

    ``queries`` is ``(by..., total_relevant)``, ``hits`` is ``(by..., rank, hit)``. Queries that
    found nothing keep a row of zeros; queries without relevant tickets belong to
    ``negative_controls``.
    """
    so_far = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = hits.where(F.col("rank") <= k).withColumn("h", F.col("hit").cast("int"))
    running = flagged.withColumn("seen", F.sum("h").over(so_far))
    totals = running.groupBy(*by).agg(
        F.count("*").alias("found"), F.sum("h").alias("good"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit"), F.col("seen") / F.col("rank"))).alias("ap"),
    )
    joined = queries.where("total_relevant > 0").join(totals, list(by), "left")
    good = F.coalesce("good", F.lit(0)).cast("bigint")
    return joined.select(
        *by,
        F.coalesce("found", F.lit(0)).cast("bigint").alias("retrieved_count"),
        good.alias("relevant_in_top_k"),
        F.col("total_relevant").cast("bigint").alias("total_relevant"),
        (good / F.lit(float(k))).alias("precision_at_k"),
        (good / F.col("total_relevant")).alias("recall_at_k"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("ap", F.lit(0.0)) / F.least(F.lit(k), F.col("total_relevant"))).alias("average_precision"),
    )


def ir_macro(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries, optionally per encoder or dataset."""
    return per_query.groupBy(*by).agg(
        F.count("*").alias("queries_evaluated"),
        round_half_even(F.avg("precision_at_k"), 4).alias("precision_at_k"),
        round_half_even(F.avg("recall_at_k"), 4).alias("recall_at_k"),
        round_half_even(F.avg("reciprocal_rank"), 4).alias("mrr"),
        round_half_even(F.avg("average_precision"), 4).alias("map"),
    )


def compare_encoders(
    queries: DataFrame, truth: DataFrame, proposals: DataFrame, tickets: DataFrame, encoders: dict, k: int = 5, threshold: float = 0.0,
) -> DataFrame:
    """``ir_macro`` per encoder: all of them answer the same queries over whole ticket texts.

    ``queries`` is ``(query_id, total_relevant)``, ``truth`` ``(query_id, ticket_id)``, ``proposals``
    ``(proposal_id, keywords)`` and ``tickets`` ``(pos, ticket_id, topic, message)``; an encoder adds a unit vector of a text column.
    """
    parts = []
    for name, encoder in encoders.items():
        asked = encoder.encode(proposals.select("proposal_id", query_text(F.col("keywords")).alias("_text")), "_text", "query_vec")
        rows = encoder.encode(tickets, embedding_text(F.col("topic"), F.col("message"))).select("pos", "ticket_id", "vec")
        found = retrieve(asked, rows, k, threshold).withColumnRenamed("proposal_id", "query_id")
        parts.append(ir_metrics(queries, mark_hits(found, truth), k).withColumn("encoder", F.lit(name)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return ir_macro(every, ("encoder",))


def negative_controls(queries: DataFrame, ranked: DataFrame, threshold: float = EVIDENCE_THRESHOLD, query: str = "query_id") -> DataFrame:
    """Top score and count at or above the gate for queries that should find nothing."""
    totals = ranked.groupBy(query).agg(
        F.max("similarity").alias("top"), F.sum((F.col("similarity") >= threshold).cast("bigint")).alias("passed")
    )
    joined = queries.select(query).join(totals, query, "left")
    passed = F.coalesce("passed", F.lit(0)).cast("bigint")
    return joined.select(
        query,
        F.coalesce(round_half_even(F.col("top"), 4), F.lit(0.0)).alias("top_similarity_score"),
        passed.alias("false_positives_above_evidence_threshold"),
        (passed == 0).alias("properly_rejected"),
    )


# --- confusion counts ----------------------------------------------------------


def _ratio(top: Column, bottom: Column, empty: Column | float) -> Column:
    empty = empty if isinstance(empty, Column) else F.lit(empty)
    return F.when(bottom > 0, top / bottom).otherwise(empty)


def confusion(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and metrics of ``is_duplicate`` against ``predicted``; undefined ratios are 1, F1 is 0."""
    t, p = F.col("is_duplicate"), F.col("predicted")

    def count(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(name)

    counts = pairs.groupBy(*by).agg(
        count(t & p, "true_positives"), count(~t & p, "false_positives"),
        count(t & ~p, "false_negatives"), count(~t & ~p, "true_negatives"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    rated = counts.withColumns({"_p": _ratio(tp, tp + fp, 1.0), "_r": _ratio(tp, tp + fn, 1.0)})
    prec, rec = F.col("_p"), F.col("_r")
    return rated.select(
        *by, tp, fp, fn, tn,
        (tp + fp + fn + tn).alias("total_annotated_pairs"),
        round_half_even(prec, 4).alias("precision"),
        round_half_even(rec, 4).alias("recall"),
        round_half_even(_ratio(tn, tn + fp, 1.0), 4).alias("specificity"),
        round_half_even(_ratio(2 * prec * rec, prec + rec, 0.0), 4).alias("f1_score"),
        round_half_even(_ratio(tp + tn, tp + tn + fp + fn, 1.0), 4).alias("accuracy"),
    )


def detected_vs_truth(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """Detected pairs against the true pairs, both ``(a, b)`` in any order; one row of counts.

    Precision of nothing detected is 1 only if there is nothing to detect.
    """

    def ordered(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(flag, F.lit(1))

    both = ordered(detected, "d").join(ordered(truth, "t"), ["a", "b"], "full")
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    counts = both.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in (
            ("true_positives", d * t), ("false_positives", d * (1 - t)), ("false_negatives", t * (1 - d)),
        )]
    )
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    nothing = F.when(tp + fn == 0, 1.0).otherwise(0.0)
    rated = counts.withColumns({"_p": _ratio(tp, tp + fp, nothing), "_r": _ratio(tp, tp + fn, 1.0)})
    prec, rec = F.col("_p"), F.col("_r")
    return rated.select(
        round_half_even(prec, 4).alias("precision"), round_half_even(rec, 4).alias("recall"),
        round_half_even(_ratio(2 * prec * rec, prec + rec, 0.0), 4).alias("f1_score"),
        tp, fp, fn,
        (tp + fp).alias("detected_pairs_count"), (tp + fn).alias("ground_truth_pairs_count"),
    )


# --- annotated duplicate pairs ---------------------------------------------------


def annotate_pairs(pairs: DataFrame, tickets: DataFrame, columns: list[str], id: str = "ticket_id") -> DataFrame:
    """Annotated pairs with the columns of both tickets as ``<name>_a`` and ``<name>_b``; unknown ids give nulls.

    The narrow pair rows are spread by both ids first: heavy text work per pair then uses all
    cores, also where one ticket occurs in very many pairs.
    """
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = pairs.repartition(width, "ticket_a", "ticket_b")
    for side in ("a", "b"):
        part = tickets.select(F.col(id).alias(f"ticket_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        out = out.join(part, f"ticket_{side}", "left")
    return out


def predict_duplicates(pairs: DataFrame, members: DataFrame, mode: str = "star", by: tuple[str, ...] = ()) -> DataFrame:
    """``predicted`` for annotated pairs from deduplicated members.

    ``star`` counts only pairs of a representative and one of its duplicates, ``closure`` every
    pair within a group. Either is read off the labels of the two tickets, no pair list is made.
    """
    if mode not in ("star", "closure"):
        raise ValueError("pairs mode must be 'star' or 'closure'")
    out = pairs
    for side in ("a", "b"):
        part = members.select(
            *by, F.col("ticket_id").alias(f"ticket_{side}"),
            F.col("component").alias(f"_c{side}"), F.col("is_representative").alias(f"_r{side}"),
        )
        out = out.join(part, [*by, f"ticket_{side}"], "left")
    together = F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))
    if mode == "star":
        together = together & (F.col("_ra") | F.col("_rb"))
    return out.withColumn("predicted", together).drop("_ca", "_cb", "_ra", "_rb")


def error_causes(pairs: DataFrame, threshold: float) -> DataFrame:
    """Wrong predictions with their error type and most likely cause.

    Input: ``is_duplicate, predicted, similarity, message_a, message_b``.
    """
    sim = F.coalesce(F.col("similarity"), F.lit(0.0))
    a, b = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("message_a", "message_b"))
    short = (F.length(a) < 30) | (F.length(b) < 30)
    common = F.array_intersect(F.split(F.lower(a), f"{WS}+"), F.split(F.lower(b), f"{WS}+"))
    telling = F.size(F.array_except(common, F.array(*[F.lit(w) for w in GENERIC_WORDS])))
    false_positive = (
        F.when((sim >= threshold) & (sim < threshold + 0.05), "threshold_too_low")
        .when(short, "short_message").when(telling <= 1, "embedding_confusion").otherwise("different_intent")
    )
    false_negative = (
        F.when((sim < threshold) & (sim >= threshold - 0.10), "threshold_too_high")
        .when(short, "short_message").otherwise("embedding_confusion")
    )
    wrong = pairs.where(F.col("is_duplicate") != F.col("predicted"))
    return wrong.withColumn("error_type", F.when(F.col("predicted"), "FALSE_POSITIVE").otherwise("FALSE_NEGATIVE")).withColumn(
        "classified_cause", F.when(F.col("predicted"), false_positive).otherwise(false_negative)
    )


def pair_features(pairs: DataFrame, vec: str = "vec") -> DataFrame:
    """Cosine, token Jaccard, 3-gram Jaccard and topic equality of annotated pairs, each computed once."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("message_a", "message_b")}
    out = pairs.withColumns({
        "jaccard": token_jaccard(text["message_a"], text["message_b"]),
        "trigram": ngram_jaccard(text["message_a"], text["message_b"]),
        "topic_match": same_topic(F.col("topic_a"), F.col("topic_b")),
    })
    if f"{vec}_a" in pairs.columns:
        out = out.withColumn("similarity", pair_similarity(f"{vec}_a", f"{vec}_b"))
    return out


def candidate_filters(features: DataFrame, configs=tuple(CANDIDATE_FILTERS)) -> DataFrame:
    """Confusion counts of each filter combination; the fixed, short list of filters is broadcast."""
    spark = features.sparkSession
    table = spark.createDataFrame(list(configs), "candidate_name string, c double, j double, g double, topic boolean")
    crossed = features.crossJoin(F.broadcast(table))
    verdict = (
        (F.col("similarity") >= F.col("c"))
        & ((F.col("j") <= 0) | (F.col("jaccard") >= F.col("j")))
        & ((F.col("g") <= 0) | (F.col("trigram") >= F.col("g")))
        & (~F.col("topic") | F.col("topic_match"))
    )
    counts = confusion(crossed.withColumn("predicted", verdict), ("candidate_name",))
    return counts.select(
        "candidate_name", "true_positives", "false_positives", "false_negatives", "true_negatives",
        "precision", "recall", "f1_score",
    )


# --- sweeps ------------------------------------------------------------------------


def _thresholds(spark, values: list[float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(float(v),) for v in values], "threshold double"))


def gate_sweep_queries(queries: DataFrame, hits: DataFrame, thresholds: list[float], query: str = "query_id") -> DataFrame:
    """Precision, recall, F1 and retention per gate value and query, from one retrieval at the lowest value.

    ``hits`` is ``(query, similarity, hit)``. Queries without relevant tickets are skipped.
    """
    gates = _thresholds(hits.sparkSession, thresholds)
    passed = F.col("similarity") >= F.col("threshold")
    counts = hits.crossJoin(gates).groupBy(query, "threshold").agg(
        F.count("*").alias("found"), F.sum(passed.cast("bigint")).alias("kept"),
        F.sum((passed & F.col("hit")).cast("bigint")).alias("tp"),
    )
    rows = queries.where("total_relevant > 0").select(query, "total_relevant").crossJoin(gates)
    joined = rows.join(counts, [query, "threshold"], "left")
    found, kept, tp = (F.coalesce(c, F.lit(0)) for c in ("found", "kept", "tp"))
    rated = joined.select(
        query, "threshold",
        _ratio(tp, kept, 1.0).alias("precision"),
        _ratio(tp, F.col("total_relevant"), 0.0).alias("recall"),
        _ratio(kept, found, 0.0).alias("retention"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1_score", _ratio(2 * p * r, p + r, 0.0))


def gate_sweep(per_query: DataFrame) -> DataFrame:
    """Means over queries per gate value."""
    return per_query.groupBy("threshold").agg(
        round_half_even(F.avg("precision"), 4).alias("precision"),
        round_half_even(F.avg("recall"), 4).alias("recall"),
        round_half_even(F.avg("f1_score"), 4).alias("f1_score"),
        round_half_even(F.avg("retention"), 4).alias("average_retention_rate"),
        F.count("*").alias("queries_evaluated"),
    )


def dedup_sweep(pairs: DataFrame, tickets: DataFrame, edges: DataFrame, thresholds: list[float], mode: str = "star") -> DataFrame:
    """Confusion counts of the duplicate groups at each threshold.

    ``edges`` are similarity edges ``(a, b, similarity)`` between positions, complete or a
    maximum spanning forest, at or above the lowest threshold; exact edges have similarity 1.
    ``tickets`` is ``(pos, ticket_id, key, chars)``. All thresholds share one components run.
    """
    steps = _thresholds(edges.sparkSession, thresholds)
    linked = edges.crossJoin(steps).where(F.col("similarity") >= F.col("threshold"))
    parts = connected_components(linked, ("threshold",))
    rows = tickets.crossJoin(steps).withColumn("node", F.col("pos"))
    labelled = rows.join(parts, ["threshold", "node"], "left").withColumn("component", F.coalesce("component", "pos")).drop("node")
    members = choose_representatives(labelled, by=("threshold",))
    judged = predict_duplicates(pairs.crossJoin(steps), members, mode, ("threshold",))
    counts = confusion(judged, ("threshold",))
    return counts.select(
        "threshold", "precision", "recall", "f1_score",
        "true_positives", "false_positives", "false_negatives", "true_negatives",
    )


# --- bootstrap -----------------------------------------------------------------------


def draw(seed: int, replicate: Column, slot: Column, n: Column | int) -> Column:
    """Reproducible draw from 0..n-1: the first 15 hex digits of md5('seed:replicate:slot') modulo n."""
    text = F.concat_ws(":", F.lit(seed), replicate.cast("string"), slot.cast("string"))
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % n


def bootstrap_ci(values: DataFrame, value: str, order: list[str], replicates: int = 1000, ci: float = 95.0, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean over resamples of the whole column.

    Draws are rows of a range and meet the values in an equi-join on the row number; the mean
    of each resample is an aggregate with map-side combine.
    """
    numbered = number_rows(values.select(*dict.fromkeys([*order, value])), order)
    n = numbered.count()
    spark = values.sparkSession
    tail = (100.0 - ci) / 200.0
    if n < 2:
        only = F.coalesce(F.round(F.max(value).cast("double"), 4), F.lit(0.0))
        return numbered.agg(F.lit(n).cast("bigint").alias("n"), only.alias("ci_lower"), only.alias("ci_upper"))
    slots = spark.range(replicates * n).select(
        F.expr(f"id div {n}").alias("replicate"), (F.col("id") % n).alias("slot")
    )
    drawn = slots.withColumn("i", draw(seed, F.col("replicate"), F.col("slot"), n))
    means = drawn.join(numbered.select("i", F.col(value).alias("v")), "i").groupBy("replicate").agg(F.avg("v").alias("mean"))
    return means.agg(
        F.lit(n).cast("bigint").alias("n"),
        round_half_even(F.percentile("mean", F.lit(tail)), 4).alias("ci_lower"),
        round_half_even(F.percentile("mean", F.lit(1.0 - tail)), 4).alias("ci_upper"),
    )


# --- clusters ------------------------------------------------------------------------


def cluster_quality(rows: DataFrame, label: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """Cosine silhouette (null unless 2 <= clusters < rows), mean cohesion and cluster count."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    per_cluster = cohesion(rows, [label], vec)
    summary = per_cluster.agg(
        round_half_even(F.avg("cohesion"), 4).alias("intra_cluster_coherence"),
        F.count("*").alias("total_clusters"), F.sum("size").alias("n"),
    )
    row = summary.first()
    score = None
    if row["n"] is not None and 2 <= row["total_clusters"] < row["n"]:
        ready = rows.select(
            array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))).alias("features"),
            F.col(label).cast("double").alias("prediction"),
        )
        score = ClusteringEvaluator(distanceMeasure="cosine").evaluate(ready)
    value = F.lit(score).cast("double")
    return summary.select(round_half_even(value, 4).alias("silhouette_score"), "intra_cluster_coherence", "total_clusters")
