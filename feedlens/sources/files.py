"""Landed CSV, JSON and text files -> canonical tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.constants import DATE_ALIASES, DEFAULT_TOPIC, ID_ALIASES, JSON_WRAPPER_KEYS, MESSAGE_ALIASES, TOPIC_ALIASES
from feedlens.functions.text import first_words, is_blank, strip
from feedlens.operators.number import number_rows, stack

FORMATS = {".csv": "csv", ".json": "json", ".txt": "txt"}
NOT_BUILT = {".xlsx", ".xls", ".pdf"}


class IngestError(ValueError):
    """Base of all ingest errors."""


class UnsupportedFileType(IngestError):
    pass


class EmptyInput(IngestError):
    pass


class InvalidSchema(IngestError):
    pass


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_aliases(columns: list[str]) -> dict[str, str]:
    """Canonical name -> column of the input. Alias order decides; of equal headers the last wins."""
    seen = {c.strip().lower(): c for c in columns}
    lists = {"ticket_id": ID_ALIASES, "created_at": DATE_ALIASES, "topic": TOPIC_ALIASES, "message": MESSAGE_ALIASES}
    found = {name: next((seen[a] for a in aliases if a in seen), None) for name, aliases in lists.items()}
    return {name: c for name, c in found.items() if c is not None}


def normalize(raw: DataFrame, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Canonical ``ticket_id, created_at, topic, message, pos`` (and the columns of ``keep``).

    Headers are resolved at plan time; rows without a message are dropped. Rows are numbered in
    ``order`` or in scan order and written out once, so ``pos`` is the same in every use; whether ids
    and topics are complete is read off that table.
    """
    keep = keep or []
    found = resolve_aliases([c for c in raw.columns if c not in keep])
    if "message" not in found:
        texts = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string" and f.name not in keep]
        if not texts:
            raise InvalidSchema("no text column for the message")
        found["message"] = texts[0]

    def text(name: str) -> Column:
        return column(found[name]).cast("string") if name in found else F.lit(None).cast("string")

    ordering = [f"_o{i}" for i in range(len(order or []))]
    rows = raw.select(
        *keep, text("ticket_id").alias("ticket_id"), text("created_at").alias("created_at"),
        text("topic").alias("topic"), strip(text("message")).alias("message"),
        *[F.col(c).alias(o) for c, o in zip(order or [], ordering)],
    ).where(~is_blank(F.col("message")))

    rows = number_rows(rows, ordering or None, "pos")
    filled = {"n": 0, "ticket_id": 0, "topic": 0}
    if "ticket_id" in found or "topic" in found:
        filled = rows.agg(F.count("*").alias("n"), F.count("ticket_id").alias("ticket_id"), F.count("topic").alias("topic")).first()
    if filled["topic"]:
        rows = rows.withColumn("topic", strip(F.coalesce("topic", F.lit(DEFAULT_TOPIC))))
    else:
        rows = rows.withColumn("topic", first_words(F.col("message")))
    if filled["ticket_id"] < filled["n"] or not filled["n"]:
        rows = rows.withColumn("ticket_id", F.coalesce("ticket_id", (F.col("pos") + 1).cast("string")))
    return rows.select(*keep, "ticket_id", "created_at", "topic", "message", "pos")


def repeated_ids(tickets: DataFrame) -> DataFrame:
    """Ids carried by more than one ticket, for instance where a generated id met a given one."""
    return tickets.groupBy("ticket_id").agg(F.count("*").alias("n")).where("n > 1")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput(f"{what} contains no records")
    return df


def with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


# --- CSV -----------------------------------------------------------------------------


def read_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All columns as text, quoted line breaks allowed. The files must share one header."""
    return spark.read.csv(paths, header=True, inferSchema=False, multiLine=True, escape='"')


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header line -> files with that header: the first line of each file's first split."""
    lines = with_source(spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    firsts = lines.groupBy("source_file").agg(F.min_by("value", "at").alias("header")).collect()
    out: dict[str, list[str]] = {}
    for row in firsts:
        out.setdefault(row["header"], []).append(row["source_file"])
    return out


# --- JSON ----------------------------------------------------------------------------


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def extract_records(v: Column) -> Column:
    """Record objects of a parsed JSON document.

    A list gives its objects; an object gives the list under the first wrapper key that holds
    one, else its object values, else itself.
    """

    def objects(items: Column) -> Column:
        return F.filter(items, lambda x: _as_map(x).isNotNull())

    wrapped = F.coalesce(*[_as_list(v, f"$.{key}") for key in JSON_WRAPPER_KEYS])
    inner = objects(F.map_values(_as_map(v)))
    return F.coalesce(
        objects(_as_list(v)), objects(wrapped), F.when(F.size(inner) > 0, inner), F.when(_as_map(v).isNotNull(), F.array(v))
    )


def variant_text(v: Column) -> Column:
    """A scalar as its text, a list or an object as JSON, JSON null as null."""
    return F.when(F.is_variant_null(v), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def read_json_records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(source_file, at, record)``, one row per record object of each file."""
    whole = with_source(spark.read.text(paths, wholetext=True))
    found = extract_records(F.parse_json("value"))
    return whole.select("source_file", F.posexplode(found).alias("at", "record"))


def record_entries(records: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep..., key, value)``: the top-level entries of each record as texts."""
    entries = records.select(*keep, F.explode(_as_map(F.col("record"))).alias("key", "v"))
    return entries.select(*keep, "key", variant_text(F.col("v")).alias("value"))


def records_to_columns(records: DataFrame, keep: list[str]) -> DataFrame:
    """One text column per key that occurs. The set of keys is read first, as for a JSON schema."""
    keys = records.select(F.explode(F.map_keys(_as_map(F.col("record")))).alias("k")).distinct().orderBy("k").collect()
    fields = records.withColumn("_m", _as_map(F.col("record")))
    return fields.select(*keep, *[variant_text(F.try_element_at("_m", F.lit(r["k"]))).alias(r["k"]) for r in keys])


# --- text ----------------------------------------------------------------------------


def read_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One ticket per line that is neither blank nor a ``#`` comment, numbered from 1 within its file.

    Splits of a file may be scanned in any order and apart from each other; within a split the lines
    are in order, so a line's number is its place in its split behind the lines of the splits before.
    """
    block = F.col("_metadata.file_block_start").alias("block")
    lines = with_source(spark.read.text(paths).select("value", "_metadata", block)).select("source_file", "block", strip(F.col("value")).alias("message"))
    lines = lines.where(~is_blank(F.col("message")) & ~F.col("message").startswith("#"))
    numbered = number_rows(lines)
    splits = numbered.groupBy("source_file", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source_file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = numbered.join(splits, ["source_file", "block"])
    return rows.select(
        "source_file", (F.col("before") + F.col("i") - F.col("first") + 1).cast("string").alias("ticket_id"),
        F.lit(None).cast("string").alias("created_at"), first_words(F.col("message")).alias("topic"),
        "message", F.col("i").alias("pos"),
    )


# --- dispatch ------------------------------------------------------------------------


def detect_format(path: str) -> str:
    extension = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in FORMATS:
        hint = "; convert it to CSV or text first" if extension in NOT_BUILT else ""
        raise UnsupportedFileType(f"unsupported file extension '{extension}'{hint}")
    return FORMATS[extension]


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All files of a path or glob, by extension, as canonical tickets with ``source_file``.

    Files of one format and header share one scan. Empty and unknown files are errors. ``pos`` is
    unique over all files.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()
    if not listed:
        raise EmptyInput(f"no files at {path}")
    by_format: dict[str, list[str]] = {}
    for row in listed:
        if row["length"] == 0:
            raise EmptyInput(f"file is empty: {row['path']}")
        by_format.setdefault(detect_format(row["path"]), []).append(row["path"])
    columns = ["source_file", "ticket_id", "created_at", "topic", "message", "pos"]
    parts = []
    if "csv" in by_format:
        for files in csv_headers(spark, by_format["csv"]).values():
            parts.append(normalize(with_source(read_csv(spark, files)), keep=["source_file"]))
    if "json" in by_format:
        records = read_json_records(spark, by_format["json"])
        parts.append(normalize(records_to_columns(records, ["source_file"]), keep=["source_file"]))
    if "txt" in by_format:
        parts.append(read_text(spark, by_format["txt"]))
    return require_rows(stack([part.select(columns) for part in parts]), path)
