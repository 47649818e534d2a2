import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.functions import vectors as V
from feedlens.operators import cluster, components, encode, pairs, retrieve


def unit_rows(n, dim=8, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if copies:
        x[-copies:] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def vector_frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "pos bigint, vec array<double>")


def brute_top(q, x, k, threshold):
    sims = np.round(q @ x.T, 9)
    out = {}
    for i, row in enumerate(sims):
        order = sorted(range(len(x)), key=lambda j: (-row[j], -j))
        out[i] = [(j, row[j]) for j in order if row[j] >= threshold][:k]
    return out


@pytest.mark.parametrize("limit", [1000, 3])
def test_retrieve_equals_brute_force_on_both_paths(spark, limit):
    x, q = unit_rows(300, copies=20), unit_rows(10, seed=8)
    proposals = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "proposal_id bigint, query_vec array<double>")
    got = retrieve.retrieve(proposals, vector_frame(spark, x), 5, 0.2, broadcast_proposals=limit).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["proposal_id"], r["rank"])):
        found.setdefault(r["proposal_id"], []).append((r["pos"], r["similarity"]))
    assert found == {i: v for i, v in brute_top(q, x, 5, 0.2).items() if v}


def test_retrieve_edge_cases(spark):
    tickets = vector_frame(spark, unit_rows(4))
    one = spark.createDataFrame([(1, [1.0, 0.0])], "proposal_id bigint, query_vec array<double>")
    none = spark.createDataFrame([], "proposal_id bigint, query_vec array<double>")
    assert retrieve.retrieve(none, tickets).count() == 0
    assert retrieve.retrieve(one, tickets, k=0).count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        retrieve.retrieve(one, tickets).collect()


def test_gate_keeps_the_boundary_and_counts_empty_proposals(spark):
    evidence = spark.createDataFrame([("p", 0.6), ("p", 0.59)], "proposal_id string, similarity double")
    proposals = spark.createDataFrame([("p",), ("q",)], "proposal_id string")
    assert retrieve.gate(evidence).count() == 1
    got = {r[0]: tuple(r)[1:] for r in retrieve.gate_counts(proposals, evidence).collect()}
    assert got == {"p": (2, 1, 1), "q": (0, 0, 0)}


@pytest.mark.parametrize("cell,pivots", [(1024, 256), (16, 4), (7, 1)])
def test_dense_pairs_equal_brute_force(spark, cell, pivots):
    x = unit_rows(120, dim=4, copies=15)
    sims = np.round(x @ x.T, 9)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= 0.9}
    df = vector_frame(spark, x)
    got = pairs.dense_pairs(df, 0.9, vec="vec", cell_rows=cell, max_pivots=pivots).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    forest = pairs.dense_pairs(df, 0.9, vec="vec", cell_rows=cell, max_pivots=pivots, forest=True)
    edges = spark.createDataFrame(sorted(want), "a bigint, b bigint")
    assert labels(components.connected_components(forest)) == labels(components.connected_components(edges))


def labels(df):
    return {(r["node"], r["component"]) for r in df.collect()}


TEXTS = ["the app crashes on start", "the app crashes on startup", "please add dark mode", "add dark mode please now",
         "battery drains fast", "", "   ", "the app crashes on start today", "!!!"] + [f"note {i} about topic {i % 7} and {i % 3}" for i in range(60)]


@pytest.mark.parametrize("hot,cell", [(2048, 1024), (3, 5), (1, 1)])
def test_sparse_pairs_equal_brute_force(spark, hot, cell):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "pos bigint, t string")
    encoder = encode.fit_text_encoder(df, "t")
    coded = encoder.encode(df, "t")
    table = coded.where("vec is not null").toArrow()
    rows, pos = V.Rows(table.column("vec")), table.column("pos").to_numpy()
    sims = V.similarity(rows, rows)
    want = {(int(pos[i]), int(pos[j])) for i, j in zip(*np.nonzero(sims >= 0.6)) if pos[i] < pos[j]}
    got = pairs.sparse_pairs(coded, encoder, 0.6, hot_feature=hot, cell_rows=cell).collect()
    assert want and len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_encoder_gives_unit_vectors_and_null_for_blanks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "pos bigint, t string")
    coded = encode.fit_text_encoder(df, "t").encode(df, "t")
    assert {r["t"] for r in coded.where("vec is null").collect()} == {"", "   ", "!!!"}
    norms = [sum(w * w for w in r["vec"]["w"]) for r in coded.where("vec is not null").collect()]
    assert np.allclose(norms, 1.0)
    assert encode.repeat_audit(coded, coded, "pos").first()["rows_differing"] == 0


def test_embedding_store_grows_by_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a",), ("b",)], "message string")
    more = spark.createDataFrame([("b",), ("c",), ("c",)], "message string")

    def coded(df):
        return df.withColumn("vec", F.array(F.length("text").cast("double")))

    for batch in (first, more):
        encode.extend_store(batch, path, "m", F.col("message"), coded)
    assert spark.read.parquet(path).count() == 3
    assert encode.with_stored_vectors(more, path, "m", F.col("message")).where("vec is not null").count() == 3


def test_norm_audit(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.6, 0.9],)], "embedding array<double>")
    assert encode.norm_audit(df).first()["norm_violations"] == 1


def test_components_of_a_long_chain_in_any_order(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    for edges in (chain, chain[::-1], [(b, a) for a, b in chain]):
        got = labels(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")))
        assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    grouped = spark.createDataFrame([("x", 1, 2), ("y", 2, 3)], "g string, a bigint, b bigint")
    got = {tuple(r) for r in components.connected_components(grouped, ("g",)).collect()}
    assert got == {("x", 1, 1), ("x", 2, 1), ("y", 2, 2), ("y", 3, 2)}


def brute_average_link(x, distance):
    groups = [[i] for i in range(len(x))]
    gap = 1 - x @ x.T
    while len(groups) > 1:
        best = min(((gap[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] >= distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return {(i, min(g)) for g in groups for i in g}


@pytest.mark.parametrize("local_rows", [512, 1])
def test_average_linkage_of_a_table_equals_brute_force(spark, local_rows):
    x = unit_rows(60, dim=3, seed=5)
    got = cluster.cluster_corpus(vector_frame(spark, x), 0.2, vec="vec", local_rows=local_rows).collect()
    assert {(r["pos"], r["cluster"]) for r in got} == brute_average_link(x, 0.2)


def test_linear_cohesion_and_medoid_equal_pairwise(spark):
    x = unit_rows(30, dim=5)
    df = vector_frame(spark, x).withColumn("g", F.col("pos") % 3)
    sims = x @ x.T
    inner = {g: [sims[i, j] for i in range(g, 30, 3) for j in range(g, 30, 3) if i != j] for g in range(3)}
    got = {r["g"]: r["cohesion"] for r in cluster.cohesion(df, ["g"], "vec").collect()}
    assert all(abs(got[g] - np.mean(inner[g])) < 1e-9 for g in got)
    central = {g: max(range(g, 30, 3), key=lambda i: (round(np.mean([sims[i, j] for j in range(g, 30, 3)]), 9), -i)) for g in range(3)}
    assert {r["g"]: r["representative_id"] for r in cluster.medoids(df, ["g"], vec="vec").collect()} == central


@pytest.mark.parametrize("local_rows", [512, 1])
def test_means_at_the_cut_and_ties_are_judged_alike_on_both_paths(spark, local_rows):
    # similarities 0.9, 0.6500000006 and 0.65: the mean of the last two rounds to the cut and must not merge
    a = np.array([1.0, 0.0, 0.0])
    b = np.array([0.9, np.sqrt(1 - 0.81), 0.0])
    c0, c1 = 0.6500000006, (0.65 - 0.9 * 0.6500000006) / np.sqrt(1 - 0.81)
    c = np.array([c0, c1, np.sqrt(1 - c0**2 - c1**2)])
    got = cluster.cluster_corpus(vector_frame(spark, np.stack([a, b, c])), 0.35, vec="vec", local_rows=local_rows).collect()
    assert {(r["pos"], r["cluster"]) for r in got} == {(0, 0), (1, 0), (2, 2)}
    square = np.array([[1.0, 0, 0], [0.8, 0.6, 0], [0.8, -0.6, 0], [0.28, 0.96, 0]])  # exact ties of neighbours
    got = cluster.cluster_corpus(vector_frame(spark, square), 0.35, vec="vec", local_rows=local_rows).collect()
    assert {(r["pos"], r["cluster"]) for r in got} == {(0, 0), (1, 0), (2, 2), (3, 3)}


def test_pairs_that_only_meet_stay_in_their_cell(spark, monkeypatch):
    """Rows with a few words in common meet by the ten thousand; only pairs whose bound reaches the threshold leave a cell."""
    monkeypatch.setattr(pairs, "STRIP_PRODUCTS", 500)
    monkeypatch.setattr(pairs, "STRIP_SUMS", 4000)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 90, 25)) for _ in range(300)]
    texts += [t + " more" for t in texts[::10]]
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, t string")
    encoder = encode.fit_text_encoder(df, "t")
    coded = encoder.encode(df, "t").select(F.col("pos").alias("id"), "vec").localCheckpoint()
    table = coded.orderBy("id").toArrow()
    rows = V.Rows(table.column("vec"))
    sims = V.similarity(rows, rows)
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(sims >= 0.7))) if i < j}
    prefixes = pairs._prefixes(coded, encoder, 0.7).withColumn("inner", F.lit(True)).localCheckpoint()
    word = prefixes.select("id", F.explode("f").alias("f"))
    meet = word.alias("x").join(word.alias("y"), F.expr("x.f = y.f and x.id < y.id")).select("x.id", "y.id").distinct().count()
    for hot, block in ((2048, 100), (5, 1000)):
        left = {(r["a"], r["b"]) for r in pairs._candidates(prefixes, 0.7, encoder.num_features, hot, block).collect()}
        assert want <= left and len(left) < meet / 4, (len(want - left), len(left), meet)


def test_vectors_meet_without_being_copied(spark, monkeypatch):
    """Chunks are read where they lie: no step of the join shuffles, however many chunks there are."""
    df = spark.createDataFrame(list(enumerate(TEXTS * 2)), "pos bigint, t string").repartition(4)
    encoder = encode.fit_text_encoder(df, "t")
    coded = encoder.encode(df, "t").select("pos", "vec").localCheckpoint()
    table = coded.where("vec is not null").toArrow()
    rows, pos = V.Rows(table.column("vec")), table.column("pos").to_numpy()
    want = {(int(pos[i]), int(pos[j])) for i, j in zip(*np.nonzero(V.similarity(rows, rows) >= 0.6)) if pos[i] < pos[j]}
    plans, plain = [], pairs.materialise
    monkeypatch.setattr(pairs, "materialise", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or plain(x))
    monkeypatch.setattr(pairs, "BLOCK_ENTRIES", 60)
    found = pairs.sparse_pairs(coded, encoder, 0.6)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r["a"], r["b"]) for r in found.collect()} == want and not [p for p in plans if "Exchange" in p]


def test_sparse_proposals_keep_no_matrix_and_score_in_column_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(retrieve, "_COLUMNS", 3)
    rng = np.random.default_rng(8)
    dense = rng.random((9, 20)) * (rng.random((9, 20)) < 0.4)
    at = [np.flatnonzero(x) for x in dense]
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in at])])
    column = V.sparse_array(sizes, np.concatenate(at), np.concatenate([x[i] for x, i in zip(dense, at)]), np.zeros(9, bool))
    block = retrieve.ProposalBlock(pa.array(range(4)), column.slice(0, 4))
    assert block.matrix is None
    assert np.allclose(block.scores(V.Rows(column), 2, 9), dense[2:] @ dense[:4].T, atol=1e-8)


def test_dense_tickets_are_not_copied_per_thousand_proposals(spark):
    x = np.random.default_rng(3).normal(size=(900, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vector_frame(spark, x)
    asked = rows.select(F.col("pos").alias("proposal_id"), F.col("vec").alias("query_vec"))
    found = retrieve.retrieve(asked, rows, 3, 0.2, broadcast_proposals=10)
    assert "sequence(0, 89" not in found._jdf.queryExecution().analyzed().toString()
    best = {(r["proposal_id"], r["rank"]): r["pos"] for r in found.where("proposal_id < 20").collect()}
    sims = np.round(x @ x.T, V.SIM_DIGITS)
    assert all(best[(i, 1)] == max(np.flatnonzero(sims[i] == sims[i].max())) for i in range(20))


def test_long_batches_are_worked_on_in_parts():
    import pyarrow as pa

    seen = []

    def twice(x):
        seen.append(len(x))
        return pa.array([2 * v for v in x.to_pylist()], pa.int64())

    assert V.in_parts(twice, pa.array(range(1300))).to_pylist() == [2 * v for v in range(1300)]
    assert max(seen) <= 512 and len(V.in_parts(twice, pa.array([], pa.int64()))) == 0


def test_rows_are_dealt_to_pivots_in_small_pieces(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 4))
    df = vector_frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    dealt, original = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: dealt.append(f) or original(self, f, *a, **k))
    pairs.dense_pairs(df, 0.1, vec="vec", cell_rows=50, max_pivots=8)
    batch = df.selectExpr("pos as id", "vec").toArrow().combine_chunks().to_batches()
    sizes = [b.num_rows for b in dealt[0](iter(batch))]
    assert len(sizes) >= 3 and max(sizes) <= 256 * 8


def test_average_linkage_of_a_table_takes_a_forest_of_edges(spark, monkeypatch):
    asked, original = [], cluster.dense_pairs
    monkeypatch.setattr(cluster, "dense_pairs", lambda *a, **k: asked.append(k.get("forest")) or original(*a, **k))
    x = np.repeat(np.eye(3), 4, axis=0) + np.random.default_rng(6).normal(scale=0.01, size=(12, 3))
    got = cluster.cluster_corpus(vector_frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), 0.2, vec="vec", local_rows=3).collect()
    assert asked == [True] and {r["pos"]: r["cluster"] for r in got} == {i: i // 4 * 4 for i in range(12)}


@pytest.mark.parametrize("held", [1, 2000, 1 << 24])
def test_chunks_meet_without_a_product_of_rows(spark, monkeypatch, held):
    """Every two chunks meet once, however many are held at a time, and no row carries two of them."""
    df = spark.createDataFrame(list(enumerate(TEXTS * 2)), "pos bigint, t string").repartition(3)
    encoder = encode.fit_text_encoder(df, "t")
    coded = encoder.encode(df, "t").select("pos", "vec").localCheckpoint()
    table = coded.where("vec is not null").toArrow()
    rows, pos = V.Rows(table.column("vec")), table.column("pos").to_numpy()
    want = sorted(tuple(sorted((int(pos[i]), int(pos[j])))) for i, j in zip(*np.nonzero(V.similarity(rows, rows) >= 0.6)) if pos[i] < pos[j])
    plans, plain = [], pairs.materialise
    monkeypatch.setattr(pairs, "materialise", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or plain(x))
    monkeypatch.setattr(pairs, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(pairs, "HELD_BYTES", held)
    found = pairs.sparse_pairs(coded, encoder, 0.6).collect()
    assert sorted((r["a"], r["b"]) for r in found) == want
    assert not [p for p in plans if "CartesianProduct" in p or "NestedLoop" in p]


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_group_norms_bound_what_rare_features_leave_out(threshold):
    """Candidates hold all pairs at the threshold and few others, whatever counts as rare."""
    import pyarrow as pa

    rng, width, n = np.random.default_rng(2), 4096, 300
    x = np.where(rng.random((n, width)) < 0.02, rng.random((n, width)) ** 3, 0.0)
    x[::5] = x[1::5] + np.where(rng.random((n // 5, width)) < 0.005, 0.3, 0.0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    row, f = np.nonzero(x)
    size = np.bincount(row, minlength=n).astype(np.int32)
    for rare in (0, 1500, width):
        norms = np.stack([np.sqrt((x[:, rare:][:, np.arange(rare, width) % 64 == g] ** 2).sum(axis=1)) for g in range(64)], axis=1).astype(np.float32)
        alone = np.bincount(row[f < rare], minlength=n).astype(np.int32)
        arrays = [np.arange(n), size, size, np.zeros(n), f.astype(np.int32), x[row, f], alone, norms]
        batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], pairs._ARRAYS)
        chunk = pairs._Chunk(batch, "", 0)
        found = [(i, j) for a, b in pairs.candidates(chunk, chunk, True, threshold, width) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(i, j) for i, j in zip(*(k.tolist() for k in np.nonzero(x @ x.T >= threshold))) if i < j}
        assert want and want <= set(found) and len(found) == len(set(found))
        if rare == width:
            assert len(found) <= len(want) + 2


def test_few_dense_pairs_are_computed_in_double_precision(monkeypatch):
    """Once every proposal holds k tickets, only pairs that single precision can't rule out are computed and ranked; ties stay exact."""
    import pyarrow as pa

    monkeypatch.setattr(retrieve, "_ROWS", 64)
    x = unit_rows(640, dim=16, copies=200)
    queries, k = unit_rows(40, dim=16, copies=0), 4
    table = pa.table({"vec": pa.array(x.tolist(), pa.list_(pa.float64())), "pos": pa.array(np.arange(640))})
    block = retrieve.ProposalBlock(pa.array(np.arange(40)), pa.array(queries.tolist(), pa.list_(pa.float64())))
    whole, plain = [], block.scores
    monkeypatch.setattr(block, "scores", lambda *a: whole.append(a[1]) or plain(*a))
    best = retrieve.BestK(block, k, -1.0, "vec", "pos")
    for at in range(0, 640, 320):
        best.add(table.slice(at, 320))
    got = best.result(pa.schema([("proposal_id", pa.int64()), ("similarity", pa.float64()), ("pos", pa.int64())])).to_pylist()
    sims = np.round(queries @ x.T, 9)
    want = {(q, int(j), sims[q, j]) for q in range(40) for j in np.lexsort((-np.arange(640), -sims[q]))[:k]}
    assert {(r["proposal_id"], r["pos"], r["similarity"]) for r in got} == want and len(got) == 160
    assert whole and len(whole) < 10 / 2, whole
