"""Public dataset layouts -> canonical tickets, and the dataset registry."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.constants import DEFAULT_TOPIC
from feedlens.functions.text import is_blank, strip
from feedlens.operators.number import number_rows, stack
from feedlens.sources.files import column, read_csv, read_json_records, records_to_columns


def _pick(raw: DataFrame, *names: str, default: str | None = None) -> Column:
    """The first of the columns that exists, as text."""
    for name in names:
        if name in raw.columns:
            return column(name).cast("string")
    return F.lit(default).cast("string")


def enforce_schema(df: DataFrame) -> DataFrame:
    """Canonical columns with defaults, trimmed; rows without a message are dropped.

    Rows are numbered and written out once; missing ids count all rows, dropped ones included.
    """
    rows = df.select(
        _pick(df, "ticket_id").alias("ticket_id"),
        F.coalesce(_pick(df, "created_at"), F.lit("")).alias("created_at"),
        strip(F.coalesce(_pick(df, "topic"), F.lit(DEFAULT_TOPIC))).alias("topic"),
        strip(F.coalesce(_pick(df, "message"), F.lit(""))).alias("message"),
    )
    rows = number_rows(rows, into="pos")
    if "ticket_id" not in df.columns:
        rows = rows.withColumn("ticket_id", (F.col("pos") + 1).cast("string"))
    rows = rows.where(~is_blank(F.col("message")))
    return rows.withColumn("ticket_id", F.coalesce("ticket_id", F.lit("")))


def _adapt(raw: DataFrame, id: Column | None, created_at: Column, topic: Column, message: Column) -> DataFrame:
    columns = [created_at.alias("created_at"), topic.alias("topic"), message.alias("message")]
    if id is not None:
        columns.insert(0, id.alias("ticket_id"))
    return enforce_schema(raw.select(*columns))


def _id(raw: DataFrame, *names: str) -> Column | None:
    return _pick(raw, *names) if set(names) & set(raw.columns) else None


def app_reviews(raw: DataFrame) -> DataFrame:
    rating = F.concat(F.lit("App Review (Rating "), _pick(raw, "score"), F.lit("/5)"))
    topic = rating if "score" in raw.columns else F.lit("Mobile App Review")
    return _adapt(raw, _id(raw, "reviewId"), _pick(raw, "at"), topic, _pick(raw, "content", "reviewText"))


def issues(raw: DataFrame) -> DataFrame:
    id = _id(raw, "number", "id")
    id = F.concat(F.lit("GH-"), id) if id is not None else None
    topic = _pick(raw, "title", default="Issue Report")
    return _adapt(raw, id, _pick(raw, "created_at"), topic, _pick(raw, "body", "message"))


def support_tickets(raw: DataFrame) -> DataFrame:
    topic = _pick(raw, "category", "topic", default="Customer Support")
    return _adapt(raw, _id(raw, "ticket_id", "tweet_id"), _pick(raw, "created_at"), topic, _pick(raw, "text", "message"))


def product_reviews(raw: DataFrame) -> DataFrame:
    id = F.concat_ws("_", _pick(raw, "reviewerID", default="REV"), _pick(raw, "asin", default="PROD"))
    topic = _pick(raw, "summary", default="Product Feedback")
    return _adapt(raw, id, _pick(raw, "reviewTime", "created_at"), topic, _pick(raw, "reviewText", "message"))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "GooglePlayAdapter": app_reviews,
    "GitHubIssuesAdapter": issues,
    "CustomerSupportAdapter": support_tickets,
    "AmazonReviewsAdapter": product_reviews,
}


def register_adapter(name: str, adapter: Callable[[DataFrame], DataFrame]) -> None:
    ADAPTERS[name] = adapter


def list_datasets(config: str | dict) -> list[dict]:
    """Entries of a registry, given as a mapping or as the path of a JSON file that Spark can read."""
    if isinstance(config, str):
        spark = SparkSession.builder.getOrCreate()
        config = json.loads(spark.read.text(config, wholetext=True).first()["value"])
    return config.get("datasets", [])


def load_dataset(spark: SparkSession, name: str, config: str | dict) -> DataFrame:
    """One registered dataset as canonical tickets with its name in ``dataset``."""
    known = {d.get("name"): d for d in list_datasets(config)}
    if name not in known:
        raise KeyError(f"dataset '{name}' is not registered, known: {sorted(known)}")
    entry = known[name]
    kind = entry.get("format", "csv").lower()
    if kind == "csv":
        raw = read_csv(spark, entry["path"])
    elif kind == "json":
        raw = records_to_columns(read_json_records(spark, entry["path"]), [])
    else:
        raise ValueError(f"unsupported format '{kind}' for dataset '{name}'")
    adapter = entry.get("adapter", "")
    if adapter not in ADAPTERS:
        raise KeyError(f"adapter '{adapter}' is not registered, known: {sorted(ADAPTERS)}")
    return ADAPTERS[adapter](raw).withColumn("dataset", F.lit(name))


def load_datasets(spark: SparkSession, config: str | dict, names: list[str] | None = None) -> DataFrame:
    """Several registered datasets, by default all of them, in one table; ``pos`` is unique over all of them."""
    names = names if names is not None else [d["name"] for d in list_datasets(config)]
    return stack([load_dataset(spark, name, config) for name in names])
