"""Prediction log on shared storage: upsert, outcomes, look-up, count and clear.

The log is a Parquet table partitioned by a hash of the record id and holds each id once. A change reads and
rewrites the partitions of the ids it names and no others, so readers need no latest-wins pass. One writer at a
time; a rewrite is computed and checkpointed before the first old file goes, so a lost executor costs a task only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators.calibrate import calibration_records, check_outcome
from feedlens.session import materialise

#: Partitions of a log. Those that a change touches are named in the scan's filter, so the list has at most this length.
BUCKETS = 64
FIELDS = {
    "record_id": "string", "proposal": "string", "predicted_score": "double", "predicted_confidence": "string",
    "predicted_recommendation": "string", "ts": "timestamp", "metadata": "map<string,string>", "actual_outcome": "double",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())


class UnknownRecord(ValueError):
    """An outcome names a record that was never predicted."""


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int")


class PredictionLog:
    """The log below ``path``; the same number of buckets has to be given every time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _table(self) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(self.path)

    def _conform(self, rows: DataFrame) -> DataFrame:
        """The log's columns: missing ones are null, others are dropped; rows without an id take no part."""
        have = set(rows.columns)
        cells = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()]
        return rows.select(*cells).where("record_id is not null").withColumn("bucket", _bucket(self.buckets))

    def _touched(self, rows: DataFrame) -> DataFrame:
        """The log's rows in the buckets of the given rows; other partitions aren't opened."""
        named = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        return self._table().where(F.col("bucket").isin(named)) if named else self._table().where("false")

    def _rewrite(self, rows: DataFrame) -> None:
        done = materialise(rows)
        # the hint makes one file per bucket, or several where a bucket is large
        done.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def save(self, rows: DataFrame) -> None:
        """Insert rows, or replace those with the same id as a whole. Of an id's rows within one call the last by ``ts``
        stays, then the one with the largest content (null times come first)."""
        fresh = materialise(self._conform(rows))
        content = F.to_json(F.struct(*[c for c in FIELDS if c != "metadata"], F.array_sort(F.map_entries("metadata")).alias("metadata")))
        both = fresh.withColumn("_new", F.lit(1)).unionByName(self._touched(fresh).withColumn("_new", F.lit(0)))
        whole = F.struct(*FIELDS, "bucket")
        newest = both.groupBy("record_id").agg(F.max_by(whole, F.struct("_new", "ts", content)).alias("r"))
        self._rewrite(newest.select("r.*"))

    def record_outcomes(self, outcomes: DataFrame, strict: bool = True) -> DataFrame:
        """Set the outcome of records from ``(record_id, actual_outcome, ts[, metadata])`` and merge metadata key by key.

        The last outcome by ``ts`` counts and replaces an earlier call's. Outcomes outside 0 to 1 are an error, and with ``strict`` so is
        an unknown id; nothing is written then. Returns the outcomes of unknown ids.
        """
        wanted = outcomes.withColumn("record_id", F.col("record_id").cast("string")).withColumn("actual_outcome", check_outcome(F.col("actual_outcome")))
        wanted = materialise(wanted.withColumn("bucket", _bucket(self.buckets)))
        old = self._touched(wanted)
        unknown = materialise(wanted.join(old.select("record_id"), "record_id", "left_anti").drop("bucket"))
        if strict and (first := unknown.select("record_id").first()):
            raise UnknownRecord(f"no prediction with record_id {first['record_id']!r}")
        joined = calibration_records(old.withColumnRenamed("actual_outcome", "_before"), wanted.drop("bucket"))
        merged = joined.withColumn("actual_outcome", F.coalesce("actual_outcome", "_before")).select(*FIELDS, "bucket")
        self._rewrite(merged)
        return unknown

    def all(self) -> DataFrame:
        return self._table().drop("bucket")

    def get(self, ids: DataFrame) -> DataFrame:
        """Records of the given ``record_id`` rows; only their buckets are read."""
        wanted = ids.select(F.col("record_id").cast("string")).distinct().withColumn("bucket", _bucket(self.buckets))
        return self._touched(wanted).join(wanted.select("record_id"), "record_id", "left_semi").drop("bucket")

    def count(self) -> int:
        return self._table().count()

    def clear(self) -> None:
        empty = self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.path)
