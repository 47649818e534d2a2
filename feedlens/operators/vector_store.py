"""Embedding store bucketed by text hash, so that looking texts up doesn't move the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.text import embedding_text

BUCKETS = 64


class VectorStore:
    """Vectors of one model by text hash: a table of ``buckets`` buckets at ``path``, kept over sessions.

    ``columns`` gives the vector's columns as DDL. Every call of ``extend`` adds at most one file per bucket, sorted by hash.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, columns: str, buckets: int = BUCKETS) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (text_hash string, {columns}) USING parquet
            CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'""")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def missing(self, texts: DataFrame, text: Column | None = None) -> DataFrame:
        """``(text_hash, text)``, once per text that the store doesn't hold; null texts are left out.

        Only the given texts are moved, to the store's buckets; both the distinct and the anti join use that order.
        """
        text = embedding_text(F.col("topic"), F.col("message")) if text is None else text
        hashed = texts.select(F.md5(text).alias("text_hash"), text.alias("text")).where("text is not null")
        once = hashed.groupBy("text_hash").agg(F.min("text").alias("text")).repartition(self.buckets, "text_hash")
        return once.join(self.table().select("text_hash").hint("merge"), "text_hash", "left_anti")

    def extend(self, texts: DataFrame, encode: Callable[[DataFrame], DataFrame], text: Column | None = None) -> None:
        """Encode the missing texts and append them; ``encode`` adds the vector's columns to ``(text_hash, text)``."""
        columns = self.table().columns
        encode(self.missing(texts, text)).select(*columns).write.insertInto(self.name)

    def attach(self, tickets: DataFrame, text: Column | None = None) -> DataFrame:
        """Tickets with their stored vectors, null where the store has none."""
        text = embedding_text(F.col("topic"), F.col("message")) if text is None else text
        hashed = tickets.withColumn("text_hash", F.md5(text))
        return hashed.join(self.table().hint("merge"), "text_hash", "left").drop("text_hash")
