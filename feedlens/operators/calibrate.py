"""Prediction log, outcomes and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.constants import CALIBRATED_BIAS, DRIFT_ECE
from feedlens.functions.text import fixed, round_half_even

TIERS = ["Low", "Moderate", "High"]


def new_predictions(proposals: DataFrame, decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """One log row per decision, with a new id and the current time."""
    rows = decisions.join(scores.select("proposal_id", "confidence"), "proposal_id")
    rows = rows.join(proposals.select("proposal_id", "proposal", "impact", "effort"), "proposal_id")
    return rows.select(
        F.expr("uuid()").alias("record_id"),
        "proposal",
        F.col("evidence_score").alias("predicted_score"),
        F.col("confidence").alias("predicted_confidence"),
        F.col("recommendation").alias("predicted_recommendation"),
        F.current_timestamp().alias("ts"),
        F.create_map(
            F.lit("priority_score"), F.col("priority_score").cast("string"),
            F.lit("decision_tier"), F.col("decision_tier"),
            F.lit("business_impact"), F.col("impact").cast("string"),
            F.lit("engineering_effort"), F.col("effort").cast("string"),
        ).alias("metadata"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest(log: DataFrame, id: str = "record_id", ts: str = "ts") -> DataFrame:
    """Latest-wins view of an append-only log: the last row saved under each id."""
    rest = [c for c in log.columns if c not in (id, ts)]
    newest = log.groupBy(id).agg(F.max(F.struct(F.col(ts).alias("ts"), F.xxhash64(*rest).alias("h"))).alias("m"))
    tagged = log.withColumn("_h", F.xxhash64(*rest))
    joined = tagged.join(newest, id).where((F.col(ts) == F.col("m.ts")) & (F.col("_h") == F.col("m.h")))
    return joined.drop("_h", "m").dropDuplicates([id])


def check_outcome(c: Column) -> Column:
    bad = F.raise_error(F.lit("actual_outcome must be a number or boolean between 0.0 and 1.0")).cast("double")
    return F.when(c.cast("double").between(0.0, 1.0), c.cast("double")).otherwise(bad)


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """``(record_id, actual_outcome[, outcome_metadata])``: the last outcome per record.

    Of two outcomes with the same time the larger wins. Metadata updates are merged key by
    key, the last value of each key counts.
    """
    checked = outcomes.withColumn("actual_outcome", check_outcome(F.col("actual_outcome")))
    last = checked.groupBy("record_id").agg(F.max(F.struct("ts", "actual_outcome"))["actual_outcome"].alias("actual_outcome"))
    if "metadata" not in outcomes.columns:
        return last
    entries = outcomes.select("record_id", "ts", F.explode("metadata").alias("k", "v"))
    newest = entries.groupBy("record_id", "k").agg(F.max(F.struct("ts", "v"))["v"].alias("v"))
    merged = newest.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("outcome_metadata"))
    return last.join(merged, "record_id", "left")


def unknown_outcomes(outcomes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Outcomes whose record was never predicted; a caller rejects or reports them."""
    return outcomes.join(predictions.select("record_id"), "record_id", "left_anti")


def calibration_records(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with their last outcome, null where it is still pending."""
    joined = predictions.join(latest_outcomes(outcomes), "record_id", "left")
    if "outcome_metadata" not in joined.columns or "metadata" not in joined.columns:
        return joined
    old = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("outcome_metadata"), k))
    merged = F.when(F.col("outcome_metadata").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("outcome_metadata"))
    merged = merged.otherwise(F.map_concat(old, "outcome_metadata"))
    return joined.withColumn("metadata", merged).drop("outcome_metadata")


def _p() -> Column:
    return F.col("predicted_score") / F.lit(100.0)


def _mean_p() -> Column:
    """Mean probability; whole scores are summed exactly, so the order of rows cannot matter."""
    known = F.when(F.col("actual_outcome").isNotNull(), F.col("predicted_score"))
    return F.sum(known) / (F.count(known) * F.lit(100.0))


def _edges(num_bins: int) -> list[float]:
    return [i * (1.0 / num_bins) for i in range(num_bins)] + [1.0]


def bin_index(p: Column, num_bins: int) -> Column:
    """Bin of a probability by comparing with the edges; the last bin is closed. Null outside [0, 1]."""
    edges = _edges(num_bins)
    index = F.when((p >= edges[num_bins - 1]) & (p <= edges[num_bins]), num_bins - 1)
    for i in range(num_bins - 1):
        index = index.when((p >= edges[i]) & (p < edges[i + 1]), i)
    return index


def _bin_totals(records: DataFrame, num_bins: int) -> DataFrame:
    done = records.where("actual_outcome is not null")
    return done.groupBy(bin_index(_p(), num_bins).alias("bin_index")).agg(
        F.count("*").alias("n"), _mean_p().alias("p"), F.avg("actual_outcome").alias("y")
    )


def reliability_bins(records: DataFrame, num_bins: int = 5) -> DataFrame:
    """Every bin with count, mean confidence, success rate and their gap; empty bins are zeros."""
    edges = _edges(num_bins)
    spark = records.sparkSession
    names = [(i, f"{edges[i]:.2f} - {edges[i + 1]:.2f}") for i in range(num_bins)]
    bins = spark.createDataFrame(names, "bin_index int, bin_range string")
    joined = bins.join(_bin_totals(records, num_bins), "bin_index", "left")
    zero = F.lit(0.0)
    return joined.select(
        "bin_index",
        "bin_range",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(round_half_even(F.col("p"), 3), zero).alias("avg_confidence"),
        F.coalesce(round_half_even(F.col("y"), 3), zero).alias("empirical_accuracy"),
        F.coalesce(round_half_even(F.abs(F.col("y") - F.col("p")), 3), zero).alias("calibration_gap"),
    )


def _correct() -> Column:
    return ((_p() >= 0.5) == (F.col("actual_outcome") >= 0.5)).cast("double")


def tier_metrics(records: DataFrame) -> DataFrame:
    """Low, Moderate and High with zeros where a tier is empty; other tier names appear nowhere."""
    done = records.where("actual_outcome is not null")
    totals = done.groupBy(F.col("predicted_confidence").alias("tier")).agg(
        F.count("*").alias("n"), F.avg("predicted_score").alias("p"), F.avg("actual_outcome").alias("y"), F.avg(_correct()).alias("ok")
    )
    tiers = records.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    zero = F.lit(0.0)
    return tiers.join(totals, "tier", "left").select(
        "tier",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(round_half_even(F.col("p"), 1), zero).alias("avg_score"),
        F.coalesce(round_half_even(F.col("y"), 3), zero).alias("empirical_success_rate"),
        F.coalesce(round_half_even(F.col("ok"), 3), zero).alias("accuracy"),
    )


def calibration_summary(records: DataFrame, num_bins: int = 5) -> DataFrame:
    """One row of metrics. A score outside every bin counts as evaluated but adds nothing to the error."""
    p, y = _p(), F.col("actual_outcome")
    known = y.isNotNull()
    totals = records.agg(
        F.count("*").alias("total"),
        F.count("actual_outcome").alias("done"),
        F.avg(F.when(known, F.pow(p - y, 2))).alias("brier"),
        F.avg(F.when(known, _correct())).alias("accuracy"),
        (_mean_p() - F.avg("actual_outcome")).alias("bias"),
    )
    inside = _bin_totals(records, num_bins).where("bin_index is not null")
    gaps = inside.agg(F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))).alias("gap"))
    both = totals.crossJoin(gaps)  # two single rows
    ece = F.when(F.col("done") > 0, F.coalesce("gap", F.lit(0.0)) / F.col("done"))
    return both.withColumn("ece", ece).select(
        F.col("total").alias("total_records"),
        F.col("done").alias("evaluated_records"),
        (F.col("total") - F.col("done")).alias("pending_records"),
        round_half_even(F.col("brier"), 4).alias("brier_score"),
        round_half_even(F.col("ece"), 4).alias("expected_calibration_error"),
        round_half_even(F.col("bias"), 4).alias("calibration_bias"),
        round_half_even(F.col("accuracy"), 3).alias("overall_accuracy"),
        F.when(F.col("done") == 0, "INSUFFICIENT_DATA").when(F.col("ece") < DRIFT_ECE, "CALIBRATED")
        .otherwise("CALIBRATION_DRIFT").alias("status"),
    )


def calibration_report(summary: DataFrame) -> DataFrame:
    """The summary row with a readable ``summary_text``."""
    bias = F.col("calibration_bias")
    tendency = (
        F.when(F.abs(bias) < CALIBRATED_BIAS, "Well-calibrated").when(bias > 0, "Overconfident").otherwise("Underconfident")
    )
    signed = F.format_string("%+.4f", round_half_even(bias, 4))
    # fixed report format
    text = F.concat(
        F.lit("Historical Calibration Report (N="), F.col("evaluated_records").cast("string"),
        F.lit("):\n- Brier Score: "), fixed(F.col("brier_score"), 4),
        F.lit(" (Optimal: 0.0)\n- Expected Calibration Error (ECE): "), fixed(F.col("expected_calibration_error"), 4),
        F.lit("\n- Calibration Tendency: "), tendency, F.lit(" (Bias: "), signed,
        F.lit(")\n- Overall Accuracy: "), fixed(F.col("overall_accuracy") * 100, 1),
        F.lit("%\n- Status: "), F.col("status"),
    )
    none = F.lit("Historical Calibration: No evaluated records with ground-truth outcomes.")
    return summary.withColumn("summary_text", F.when(F.col("evaluated_records") == 0, none).otherwise(text))
