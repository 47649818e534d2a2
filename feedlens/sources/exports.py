"""Landed exports of support desks, conversation tools and page databases -> canonical tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.sources.files import IngestError, normalize, read_csv, record_entries, require_rows, variant_text, with_source

# property kinds whose value sits under the name of the kind
PLAIN_KINDS = ["number", "checkbox", "url", "email", "phone_number", "created_time", "last_edited_time"]


def read_pages(spark: SparkSession, path: str | list[str], results_key: str) -> DataFrame:
    """``(source_file, at, record)`` of all page files of an export, the pages in file-name order."""
    whole = with_source(spark.read.text(path, wholetext=True))
    found = F.try_variant_get(F.parse_json("value"), f"$.{results_key}", "array<variant>")
    return whole.select("source_file", F.posexplode(found).alias("at", "record"))


def _text(path: str) -> Column:
    return F.try_variant_get("record", path, "string")


def support_desk(records: DataFrame) -> DataFrame:
    return records.select(
        *[c for c in records.columns if c != "record"],
        _text("$.id").alias("ticket_id"), _text("$.created_at").alias("created_at"),
        F.coalesce(_text("$.subject"), F.lit("")).alias("topic"), F.coalesce(_text("$.description"), F.lit("")).alias("message"),
    )


def conversations(records: DataFrame) -> DataFrame:
    subject = F.nullif(_text("$.source.subject"), F.lit(""))
    return records.select(
        *[c for c in records.columns if c != "record"],
        _text("$.id").alias("ticket_id"), _text("$.created_at").alias("created_at"),
        F.coalesce(subject, _text("$.title"), F.lit("")).alias("topic"),
        F.coalesce(_text("$.source.body"), F.lit("")).alias("message"),
    )


def _names(p: Column, path: str, field: str, glue: str) -> Column:
    parts = F.coalesce(F.try_variant_get(p, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, f"$.{field}", "string"), F.lit(""))), glue)


def _name(p: Column, kind: str, field: str) -> Column:
    present = F.try_variant_get(p, f"$.{kind}", "map<string,variant>").isNotNull()
    return F.when(present, F.coalesce(F.try_variant_get(p, f"$.{kind}.{field}", "string"), F.lit("")))


def property_value(p: Column) -> Column:
    """Flat text of one tagged page property."""
    kind = F.try_variant_get(p, "$.type", "string")
    value = F.when(kind == "title", _names(p, "$.title", "plain_text", ""))
    value = value.when(kind == "rich_text", _names(p, "$.rich_text", "plain_text", ""))
    value = value.when(kind == "multi_select", _names(p, "$.multi_select", "name", ", "))
    value = value.when(kind == "select", _name(p, "select", "name")).when(kind == "status", _name(p, "status", "name"))
    value = value.when(kind == "date", _name(p, "date", "start"))
    for plain in PLAIN_KINDS:
        raw = F.try_variant_get(p, f"$.{plain}", "variant")
        missing = F.lit("false") if plain == "checkbox" else F.lit(None).cast("string")
        value = value.when(kind == plain, F.when(raw.isNull(), missing).otherwise(variant_text(raw)))
    other = F.try_element_at(F.try_variant_get(p, "$", "map<string,variant>"), kind)
    return value.otherwise(F.coalesce(variant_text(other), F.lit("")))


def page_properties(records: DataFrame) -> DataFrame:
    """One row per page, one column per property name, plus ``_page_id`` and ``_created_time``."""
    keep = [c for c in records.columns if c != "record"]
    props = F.try_variant_get("record", "$.properties", "map<string,variant>")
    names = records.select(F.explode(F.map_keys(props)).alias("k")).distinct().orderBy("k").collect()
    pages = records.withColumn("_p", props)
    return pages.select(
        *keep,
        *[F.when(F.map_contains_key("_p", r["k"]), property_value(F.try_element_at("_p", F.lit(r["k"])))).alias(r["k"]) for r in names],
        F.coalesce(_text("$.id"), F.lit("")).alias("_page_id"),
        F.coalesce(_text("$.created_time"), F.lit("")).alias("_created_time"),
    )


# source -> key of the record list in a page, flattener
JSON_EXPORTS = {
    "zendesk": ("tickets", support_desk),
    "intercom": ("conversations", conversations),
    "notion": ("results", page_properties),
}
CSV_EXPORTS = ["google_sheets"]


def load_export(spark: SparkSession, source: str, path: str | list[str]) -> DataFrame:
    """Canonical tickets of a landed export, with ``source_file``."""
    if source in JSON_EXPORTS:
        key, flatten = JSON_EXPORTS[source]
        records = require_rows(read_pages(spark, path, key), f"{source} export")
        return normalize(flatten(records), order=["source_file", "at"], keep=["source_file"])
    if source in CSV_EXPORTS:
        return normalize(require_rows(with_source(read_csv(spark, path)), f"{source} export"), keep=["source_file"])
    known = ", ".join(sorted([*JSON_EXPORTS, *CSV_EXPORTS]))
    raise IngestError(f"unknown source '{source}', known: {known}")
