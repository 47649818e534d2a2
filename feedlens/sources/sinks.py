"""Writers for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Result table as parquet or JSON lines, by partition columns where given."""
    if format not in ("parquet", "json"):
        raise ValueError(f"unsupported output format '{format}'")
    writer = df.write.mode(mode).format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_texts(df: DataFrame, path: str, by: str = "proposal_id", text: str = "prompt", mode: str = "overwrite") -> None:
    """One folder per proposal with its text, for readers that want plain files."""
    df.select(by, text).write.mode(mode).option("lineSep", "\n\n").partitionBy(by).text(path)
