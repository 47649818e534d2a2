"""Prediction log and vector store on shared storage."""

import os

import pytest
from pyspark.sql import functions as F

from feedlens.operators.prediction_log import PredictionLog, UnknownRecord
from feedlens.operators.vector_store import VectorStore
from feedlens.session import work_folder

ROW = "record_id string, predicted_score double, ts timestamp, metadata map<string,string>"


def times(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def rows(spark, data):
    return times(spark.createDataFrame(data, ROW.replace("timestamp", "string")))


def view(log):
    return {r["record_id"]: (r["predicted_score"], r["actual_outcome"], r["metadata"]) for r in log.all().collect()}


@pytest.fixture
def log(spark):
    return PredictionLog(spark, work_folder(spark, "log"), buckets=8)


def test_save_replaces_whole_records_and_keeps_the_others(spark, log):
    assert log.count() == 0 and log.all().columns[0] == "record_id"
    log.save(rows(spark, [("a", 1.0, "2024-01-01", {"k": "1"}), ("b", 2.0, "2024-01-01", None), (None, 5.0, None, None)]))
    log.save(rows(spark, [("a", 3.0, "2023-01-01", None), ("c", 4.0, "2024-01-01", {}), ("c", 9.0, None, {}), ("c", 4.0, "2024-01-01", {})]))
    assert view(log) == {"a": (3.0, None, None), "b": (2.0, None, None), "c": (4.0, None, {})}
    assert log.count() == 3


def test_outcomes_overwrite_and_merge(spark, log):
    log.save(rows(spark, [("a", 1.0, "2024-01-01", {"k": "1", "l": "2"}), ("b", 2.0, "2024-01-01", None)]))
    schema = "record_id string, actual_outcome double, ts string, metadata map<string,string>"
    first = times(spark.createDataFrame([("a", 0.0, "2024-02-01", {"l": "x"}), ("a", 1.0, "2024-02-02", {"m": "3"})], schema))
    assert log.record_outcomes(first).count() == 0
    assert view(log) == {"a": (1.0, 1.0, {"k": "1", "l": "x", "m": "3"}), "b": (2.0, None, None)}
    log.record_outcomes(times(spark.createDataFrame([("a", 0.5, "2020-01-01", None), ("b", 0.25, None, {"n": "4"})], schema)))
    assert view(log) == {"a": (1.0, 0.5, {"k": "1", "l": "x", "m": "3"}), "b": (2.0, 0.25, {"n": "4"})}


def test_unknown_and_invalid_outcomes_write_nothing(spark, log):
    log.save(rows(spark, [("a", 1.0, "2024-01-01", None)]))
    schema = "record_id string, actual_outcome double, ts string"
    unknown = times(spark.createDataFrame([("a", 1.0, "2024-02-01"), ("z", 1.0, "2024-02-01")], schema))
    with pytest.raises(UnknownRecord):
        log.record_outcomes(unknown)
    with pytest.raises(Exception, match="between 0.0 and 1.0"):
        log.record_outcomes(times(spark.createDataFrame([("a", 1.5, "2024-02-01")], schema)))
    assert view(log) == {"a": (1.0, None, None)}
    assert [r["record_id"] for r in log.record_outcomes(unknown, strict=False).collect()] == ["z"]
    assert view(log) == {"a": (1.0, 1.0, None)}


def test_get_count_and_clear(spark, log):
    log.save(rows(spark, [(str(i), float(i), "2024-01-01", None) for i in range(40)]))
    got = log.get(spark.createDataFrame([("7",), ("7",), ("nope",)], "record_id string"))
    assert [(r["record_id"], r["predicted_score"]) for r in got.collect()] == [("7", 7.0)]
    assert log.get(spark.createDataFrame([], "record_id string")).count() == 0
    log.clear()
    assert log.count() == 0
    log.save(rows(spark, [("a", 1.0, None, None)]))
    assert log.count() == 1


def test_only_touched_buckets_are_rewritten(spark, log):
    log.save(rows(spark, [(str(i), float(i), "2024-01-01", None) for i in range(40)]))

    def files():
        return {os.path.relpath(os.path.join(d, f), log.path) for d, _, fs in os.walk(log.path.replace("file:", "")) for f in fs if f.endswith("parquet")}

    before = files()
    log.save(rows(spark, [("7", 70.0, "2024-01-01", None)]))
    after = files()
    assert len({f.split(os.sep)[-2] for f in before - after}) == 1 and len(before & after) >= len(before) - 1
    assert log.count() == 40


def encode(fresh):
    return fresh.withColumn("vec", F.array(F.length("text").cast("double")))


def test_store_embeds_each_text_once(spark):
    store = VectorStore(spark, "store_once", work_folder(spark, "store"), "vec array<double>", buckets=4)
    first = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,), ("",)], "t string")
    second = spark.createDataFrame([("bb",), ("ccc",)], "t string")
    seen = []
    for batch in (first, second, second):
        seen.append(sorted(r["text"] for r in store.missing(batch, F.col("t")).collect()))
        store.extend(batch, encode, F.col("t"))
    assert seen == [["", "a", "bb"], ["ccc"], []]
    assert store.table().count() == 4
    got = store.attach(second.union(spark.createDataFrame([("new",)], "t string")), F.col("t"))
    assert sorted((r["t"], r["vec"]) for r in got.collect() if r["vec"]) == [("bb", [2.0]), ("ccc", [3.0])] and got.count() == 3


def test_store_opened_again_keeps_its_rows(spark):
    path = work_folder(spark, "store")
    VectorStore(spark, "store_a", path, "vec array<double>", buckets=4).extend(spark.createDataFrame([("a",)], "t string"), encode, F.col("t"))
    again = VectorStore(spark, "store_b", path, "vec array<double>", buckets=4)
    assert again.missing(spark.createDataFrame([("a",), ("b",)], "t string"), F.col("t")).select("text").collect() == [("b",)]


def test_store_side_is_not_shuffled(spark):
    store = VectorStore(spark, "store_plan", work_folder(spark, "store"), "vec array<double>", buckets=4)
    store.extend(spark.range(100).selectExpr("cast(id as string) t"), encode, F.col("t"))
    for df in (store.missing(spark.range(9).selectExpr("cast(id as string) t"), F.col("t")), store.attach(spark.range(9).selectExpr("cast(id as string) t"), F.col("t"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(plan.splitlines()) if "store_plan" in line)
        join = next(i for i, line in enumerate(plan.splitlines()) if "SortMergeJoin" in line)
        right = plan.splitlines()[join + 1 : scan + 1]
        depth = min(line.index("+- ") for line in right if "+- " in line)
        side = "\n".join(line for line in plan.splitlines()[join + 1 :] if line[depth:].startswith("+- ") or line[depth:].startswith("   "))
        assert "store_plan" in side and "Exchange" not in side, plan
