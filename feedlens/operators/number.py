"""Contiguous row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.session import materialise


def stack(parts: list[DataFrame], column: str = "pos") -> DataFrame:
    """Union of numbered tables whose numbers stay unique: each part starts behind the part before it.

    The parts must be written out already, so that their numbers can't change; one number per part reaches the driver.
    """
    out, start = None, 0
    for part in parts:
        moved = part.withColumn(column, F.col(column) + F.lit(start))
        start += (part.agg(F.max(column)).first()[0] or 0) + 1
        out = moved if out is None else out.unionByName(moved)
    return out


def number_rows(df: DataFrame, order: list[str] | None = None, into: str = "i") -> DataFrame:
    """Numbers 0..n-1 in the given order, or in the order of the scan.

    Rows keep their (range) partition; each partition starts at the number of rows before it.
    Only one count per partition reaches the driver.
    """
    placed = df
    if order:
        placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # written out once: a second run could draw other range borders
    at = F.monotonically_increasing_id()
    placed = materialise(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", at % F.lit(1 << 33)))
    starts, total = [], 0
    for row in placed.groupBy("_part").count().orderBy("_part").collect():
        starts.append((row["_part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    numbered = placed.join(F.broadcast(offsets), "_part")  # one row per partition
    return numbered.withColumn(into, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
