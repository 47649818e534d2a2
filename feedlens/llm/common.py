"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from feedlens.session import materialise, small_batches

__all__ = ["forest", "materialise", "parts_of", "shared_folder", "small_batches", "stored", "words_of"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the session's own folder in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        materialise(spark.range(1))
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def stored(df: DataFrame, **options) -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared folder and reading it back.

    Unlike a checkpoint it is compressed and later readers load only the columns they need. The
    table is removed when the session's file systems close. ``options`` go to the writer.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of a task in small batches, so that a worker turns few texts into Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as bytes, with A-Z in lower case.

    On bytes, ``lower`` changes A-Z alone and ``split`` cuts at exactly those six white-space
    characters, so both follow the rule without a pattern.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of ``(a, b)`` that join two trees so far; ``parent`` is updated."""

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    done = np.zeros(len(a), dtype=bool)
    while True:
        flat = parent
        while True:  # point every node at its root
            up = flat[flat]
            if (up == flat).all():
                break
            flat = up
        parent[:] = flat
        done |= flat[a] == flat[b]
        rest = np.flatnonzero(~done)
        if not len(rest):
            return kept
        # one edge per tree on the left side a round, so the loop is short even for many pairs
        _, first = np.unique(flat[a[rest]], return_index=True)
        for k in rest[first]:
            x, y = root(int(a[k])), root(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((int(a[k]), int(b[k])))
            done[k] = True
