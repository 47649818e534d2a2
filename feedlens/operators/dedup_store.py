"""Duplicate components of a ticket table that grows by batches; stored tickets are never compared with each other again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.constants import DEDUP_THRESHOLD
from feedlens.functions.text import embedding_text, ticket_key
from feedlens.operators.components import connected_components
from feedlens.operators.encode import TextEncoder
from feedlens.operators.pairs import BLOCK_ROWS, HOT_FEATURE, RANKED, _dealt, _met, _packed, _ranked, _rare_ranks
from feedlens.session import materialise, small_batches, spread


def sparse_delta_pairs(old: DataFrame, new: DataFrame, threshold: float, encoder: TextEncoder, hot_feature: int = HOT_FEATURE, cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between new rows of ``pairs._ranked`` and any rows; pairs of two old rows aren't looked at.

    The same bounds as in ``pairs.sparse_pairs``: prefixes depend on the encoder alone, so those of the old rows are read from
    their table, and only those with a feature that the new rows have. Chunks of new rows meet chunks of any rows in cells,
    which pass on a spanning forest of their edges.
    """
    asked = np.zeros(encoder.num_features, bool)  # one bit per feature of the encoder, as its own state has one count
    asked[new.select(F.explode(F.slice("f", F.lit(1), F.col("kept"))).alias("f")).distinct().toArrow().column("f").to_numpy()] = True
    rare = _rare_ranks(encoder.counts.value, encoder.n_texts, threshold, hot_feature)
    with small_batches(new.sparkSession):
        fresh = materialise(_packed(new, True, cell_rows, rare))
        reached = materialise(_packed(old, False, cell_rows, rare, asked))
    chunks = _dealt(fresh).unionByName(_dealt(reached).withColumn("chunk", -F.col("chunk") - 1))
    return _met(chunks, threshold, encoder.num_features, True).select("a", "b")


class DedupStore:
    """Components of all tickets added so far, in Parquet tables below ``path``; the encoder and threshold stay the same.

    After any batches the components are those of ``dedup.corpus_components`` over all their tickets at once: equal
    keys or a similarity of at least ``threshold``, transitively, named by their lowest position. Each batch adds its positions, new
    texts, their vectors and prefixes; its edges are drawn between components, not tickets, so merging two stored components
    adds one row to the table of moved components and rewrites no ticket. A batch counts once its last table is written; one that
    broke off is written anew by the next call.
    """

    TABLES = {
        "positions": "pos bigint, text_hash string", "texts": "text_hash string, key string, canon bigint, component bigint",
        "vectors": RANKED, "moved": "root bigint, component bigint",
        "done": "last bigint",
    }

    def __init__(self, spark: SparkSession, path: str, encoder: TextEncoder, threshold: float = DEDUP_THRESHOLD) -> None:
        if not 0.0 < threshold <= 1.0:
            raise ValueError(f"the threshold of a store lies above 0 and at most at 1, got {threshold}")
        self.spark, self.path, self.encoder, self.threshold = spark, path, encoder, threshold

    def _read(self, name: str, batches: int) -> DataFrame:
        schema = f"{self.TABLES[name]}, batch int"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch") < batches)

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _state(self) -> tuple[int, int]:
        """Number of batches and the last position."""
        row = self._read("done", 1 << 30).agg(F.max("batch").alias("b"), F.max("last").alias("last")).first()
        return (0, -(1 << 62)) if row["b"] is None else (row["b"] + 1, row["last"])

    def _moved(self, batches: int) -> DataFrame:
        """Where stored components have gone: each batch writes the whole table, the last one counts."""
        return self._read("moved", batches).where(F.col("batch") == batches - 1).drop("batch")

    def add(self, tickets: DataFrame) -> None:
        """Add tickets ``(pos, topic, message)``; their positions must lie behind those of all earlier batches. Null positions are an error."""
        batch, last = self._state()
        topic, message = F.col("topic"), F.col("message")
        keys = materialise(spread(tickets).select("pos", F.md5(ticket_key(topic, message)).alias("key"), F.md5(embedding_text(topic, message)).alias("text_hash")))
        span = keys.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_if(F.col("pos").isNull()).alias("without")).first()
        if span["without"] or (span["low"] is not None and span["low"] <= last):
            raise ValueError(f"positions must be given and lie behind {last}")
        known = self._read("texts", batch).drop("batch")
        texts = keys.groupBy("text_hash").agg(F.min("pos").alias("canon"), F.min("key").alias("key"))
        fresh = materialise(texts.join(known.select("text_hash"), "text_hash", "left_anti"))

        same_key = fresh.select("key", "canon").unionByName(known.join(fresh.select("key").distinct(), "key", "left_semi").select("key", "canon"))
        first = same_key.groupBy("key").agg(F.min("canon").alias("low"))
        exact = fresh.join(first, "key").where("canon <> low").select(F.col("canon").alias("a"), F.col("low").alias("b"))
        rows = tickets.join(fresh.select(F.col("canon").alias("pos")), "pos", "left_semi")
        vectors = rows.select(F.col("pos").alias("id"), self.encoder.column(embedding_text(topic, message)).alias("vec"))
        with small_batches(self.spark):
            self._write("vectors", _ranked(vectors, self.encoder, self.threshold), batch)
        stored = self._read("vectors", batch + 1)
        old, new = (stored.where(which).drop("batch") for which in (F.col("batch") < batch, F.col("batch") == batch))
        near = sparse_delta_pairs(old, new, self.threshold, self.encoder)

        edges = materialise(exact.unionByName(near))
        moved = self._moved(batch)
        ends = edges.select(F.explode(F.array("a", "b")).alias("canon")).distinct()
        roots = known.join(ends, "canon", "left_semi").select("canon", F.col("component").alias("root")).join(moved, "root", "left")
        roots = materialise(roots.select("canon", F.coalesce("component", "root").alias("root")))

        def contracted(side: str) -> DataFrame:
            return roots.select(F.col("canon").alias(side), F.col("root").alias(f"r{side}"))

        drawn = edges.join(contracted("a"), "a", "left").join(contracted("b"), "b", "left")
        parts = connected_components(drawn.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        parts = materialise(parts.where("node <> component"))

        labelled = fresh.join(parts.select(F.col("node").alias("canon"), "component"), "canon", "left")
        labelled = labelled.select("text_hash", "key", "canon", F.coalesce("component", "canon").alias("component"))
        again = moved.join(parts.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        again = again.select("root", F.coalesce("to", "component").alias("component"))
        joined = roots.select("root").distinct().join(parts.select(F.col("node").alias("root"), "component"), "root")
        for name, table in (
            ("positions", keys.select("pos", "text_hash")), ("texts", labelled),
            ("moved", again.unionByName(joined)),
        ):
            self._write(name, table, batch)
        high = last if span["high"] is None else span["high"]
        self._write("done", self.spark.createDataFrame([(high,)], "last bigint"), batch)

    def components(self) -> DataFrame:
        """``(pos, component)`` of all tickets added so far."""
        batches, _ = self._state()
        texts = self._read("texts", batches).select("text_hash", F.col("component").alias("root"))
        named = texts.join(self._moved(batches), "root", "left").select("text_hash", F.coalesce("component", "root").alias("component"))
        return self._read("positions", batches).join(named, "text_hash").select("pos", "component")
