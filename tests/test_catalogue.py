"""Catalogue queries against their SQL on the smallest tables, and their plans."""

import pytest
from oracle_check import compare, connect

from feedlens.plans import catalog, oracle, tables

SF = "/root/testdata/sf0.001"
FAST = ["q_normalize_tickets", "q_exact_dedup_longest", "q_exact_dedup_stats", "q_tfidf_topk", "q_similar_pairs_vectors", "q_components",
        "q_semantic_dedup_stats", "q_evidence_score", "q_decision", "q_decision_arrays", "q_decision_pipeline", "q_calib_summary",
        "q_calib_bins", "q_ir_metrics", "q_candidate_filters", "q_gate_sweep", "q_bootstrap_ci", "q_silhouette"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, name):
    assert compare(spark, connect(SF), SF, name, catalog.QUERIES[name], oracle.ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(oracle.ORACLE) <= set(catalog.QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle_and_reads_needed_columns(spark):
    text = plan(catalog.q_tfidf_topk(spark, SF))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text


def test_label_statistics_read_one_column(spark):
    assert "ReadSchema: struct<label:int>" in plan(tables.vectors(spark, SF).groupBy("label").count())


def test_gate_sweep_of_two_labels(spark, tmp_path):
    """Four vectors in two directions: gates up to 0.5 keep one hit of one, none is lost to a name that isn't there."""
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.q_gate_sweep(spark, str(tmp_path)).orderBy("threshold").collect()
    assert [r["threshold"] for r in got] == catalog.GATES
    assert all(r.asDict() | {"threshold": 0} == {"threshold": 0, "precision": 1.0, "recall": 1.0, "f1_score": 1.0, "average_retention_rate": 1.0, "queries_evaluated": 4} for r in got)
