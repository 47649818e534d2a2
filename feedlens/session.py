"""Session and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "feedlens", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution (skew split, partition coalescing) and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so that a lost executor costs one stage only.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where none is set, it lies
    under the home folder of the cluster's default file system; only a session on one machine, as in
    tests, takes a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or _own_folder(spark))
    return df.checkpoint(eager=True)


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="feedlens-checkpoint-")
    system = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
    return f"{system.getHomeDirectory().toString()}/feedlens-checkpoints"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While it lasts, jobs hand rows to Python in Arrow batches of at most ``rows``: whole texts are held
    twice, by the executor and by its worker, so the default of 10,000 rows may take hundreds of MB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A small input is shuffled once more, texts and all; above this its files have scan partitions enough.
SMALL_INPUT = 16 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for a small input before heavy row work; large inputs stay as they are.

    A small file is one scan partition and would keep a single core busy. The decision uses the
    optimizer's size estimate only, nothing runs.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it is removed when the session's file systems close."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            materialise(spark.range(1))
        base = str(spark.sparkContext.getCheckpointDir())
    place = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place
