"""Approximate nearest neighbours with a forest of hash-prefix trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import stored
from feedlens.llm.vectors import matrix, rotation, runs, usable_vectors

SEED = 6
TREES = 12
#: Hash characters (bits) of a string.
BITS = 64
#: Rows whose projections set the middle of each hash bit.
FIT_ROWS = 4096
#: Rows that the shortest strings' prefixes hold on average; longer prefixes are told apart within a task.
CELL_ROWS = 2048
#: Rows compared at a time in a task; larger cells are cut into blocks of this many rows.
BLOCK_ROWS = 4096
#: Queries compared exactly with all rows to choose how many candidates a search gathers, and their recall.
TUNE_QUERIES = 192
TARGET_RECALL = 0.96


@dataclass(frozen=True)
class Forest:
    """Hash functions of all trees, the depth of the stored prefixes and the candidates to gather."""

    dim: int
    planes: np.ndarray  # trees x BITS x dim
    middles: np.ndarray  # trees x BITS
    depth: int
    gather: int = 0

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings of all vectors (rows) in all trees (columns) as unsigned integers, first character highest."""
        out = np.empty((len(vectors), len(self.planes)), dtype=np.uint64)
        for t, (plane, middle) in enumerate(zip(self.planes, self.middles, strict=True)):
            bits = np.packbits(vectors @ plane.T > middle, axis=1)
            out[:, t] = np.ascontiguousarray(bits).view(">u8").ravel()
        return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of hash strings, elementwise."""
    differ = a ^ b
    high = (differ >> np.uint64(32)).astype(np.float64)
    low = (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    # exponents of exact 32-bit halves: the position of the highest differing bit
    return np.where(high > 0, 32 - np.frexp(high)[1], np.where(low > 0, 64 - np.frexp(low)[1], 64))


def fit_forest(rows: DataFrame, dim: int, count: int) -> Forest:
    """Hash functions from at most ``FIT_ROWS`` rows, those with the lowest hash of their id; every row is indexed."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").collect()
    seen = np.array([r["vec"] for r in sample], dtype=np.float64).reshape(-1, dim)
    planes = rotation(TREES * BITS, dim, SEED).reshape(TREES, BITS, dim)
    middles = np.stack([np.median(seen @ p.T, axis=0) for p in planes]) if len(seen) else np.zeros((TREES, BITS))
    return Forest(dim, planes, middles, max(0, ceil(log2(max(1, count / CELL_ROWS)))))


def exact_distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[tuple[int, float, int]]:
    """``(query position, distance, row position)`` of the ``k`` nearest allowed rows of each query, ties to the smaller id.

    A matrix product shortlists with a margin far above its rounding, ties included; distances
    are then computed from the differences.
    """
    square = (vectors**2).sum(axis=1)
    product = (queries**2).sum(axis=1)[:, None] + square[None, :] - 2 * queries @ vectors.T
    product[query_ids[:, None] == ids[None, :]] = np.inf
    if allowed is not None:
        product[~allowed] = np.inf
    out = []
    for q in range(len(queries)):
        row = product[q]
        if len(row) > k:
            border = np.partition(row, k - 1)[k - 1]
            scale = square.max(initial=0) + (queries[q] ** 2).sum()
            near = np.flatnonzero(row <= border + 1e-9 * scale) if np.isfinite(border) else np.flatnonzero(np.isfinite(row))
        else:
            near = np.flatnonzero(np.isfinite(row))
        distance = exact_distances(queries[q], vectors[near])
        order = np.lexsort((ids[near], distance))[:k]
        out += [(q, float(distance[o]), int(near[o])) for o in order]
    return out


def tune(rows: DataFrame, queries: DataFrame, forest: Forest, k: int, levels: DataFrame) -> int:
    """Candidates a search must gather for ``TARGET_RECALL`` on a bounded sample of queries.

    The sampled queries are compared with every row; each true neighbour tells the longest prefix
    it shares with its query in any tree, and so from which level on it would be found.
    """
    sample = queries.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(TUNE_QUERIES).collect()
    if not sample:
        return 0
    ids = np.array([r["id"] for r in sample])
    vectors = np.array([r["vec"] for r in sample], dtype=np.float64)
    strings = forest.strings(vectors)
    dim = forest.dim

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                own, held = part.column(0).to_numpy(), matrix(part.column(1), dim)
                found = nearest(vectors, ids, held, own, k)
                if not found:
                    continue
                q, distance, row = (np.array(c) for c in zip(*found, strict=True))
                shared = common_prefix(strings[q], forest.strings(held[row])).max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), pa.array(distance), pa.array(own[row]), pa.array(shared, pa.int32())], names=["query_id", "score", "id", "shared"]
                )

    found = rows.select("id", "vec").mapInArrow(best, "query_id bigint, score double, id bigint, shared int")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id", "shared"))), 1, k).alias("top"))
    truth = top.select("query_id", F.col("top.shared").alias("shared"))
    counts = levels.join(F.broadcast(truth), "query_id").select("query_id", "level", "held", "shared").collect()
    by_query: dict[int, list] = {}
    for r in counts:
        hits = sum(s >= r["level"] for s in r["shared"])
        by_query.setdefault(r["query_id"], []).append((r["level"], r["held"], hits, len(r["shared"])))
    for seq in by_query.values():
        seq.sort(reverse=True)  # from the longest prefix to the root
    amounts = sorted({h for seq in by_query.values() for _, h, _, _ in seq})
    low, high = 0, len(amounts) - 1
    while low < high:  # recall grows with the candidates gathered
        middle = (low + high) // 2
        hits = total = 0
        for seq in by_query.values():
            _, _, hit, of = next((x for x in seq if x[1] >= amounts[middle]), seq[-1])
            hits, total = hits + hit, total + of
        low, high = (low, middle) if hits >= TARGET_RECALL * total else (middle + 1, high)
    return amounts[low]


def nearest_neighbours(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row its ``k`` nearest other rows found, by Euclidean distance.

    Each tree hashes every row to a long string of bits. A search starts at the longest stored
    prefix of its string in every tree and ascends in all trees at once, a level at a time, until the
    rows below its prefixes reach the number that ``tune`` found necessary; all of these are then
    compared exactly, however many they are, ties by smaller id. Prefixes are the shuffle keys:
    rows go to one cell per tree, queries to the cells below the prefix they have ascended to,
    cells above ``BLOCK_ROWS`` rows are cut into blocks, and every block passes on ``k`` rows per
    query. With ``k`` rows or fewer in all, every candidate is returned.

    Vectors that are null, zero, of another length than most or hold null or non-finite components,
    and rows with a null id, take no part. Rows that repeat an id are one candidate. Other columns
    are ignored; an empty table, or one without queries, gives no rows. ``is_query`` is a condition on the id column.
    """
    usable, dim = usable_vectors(df, id_col, vec_col)
    rows = stored(usable.dropDuplicates(["id"]))
    queries = stored(rows.join(df.where(is_query).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    schema = "query_id bigint, rank int, id bigint, score double"
    count = rows.count()
    if not count or queries.isEmpty():
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    forest = fit_forest(rows, dim, count)
    depth, trees = forest.depth, TREES

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per tree with the prefix of ``depth`` bits as cell."""
        for batch in batches:
            if not batch.num_rows:
                continue
            found = forest.strings(matrix(batch.column(1), dim))
            for t in range(trees):
                cell = (found[:, t] >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(found), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(found), t, np.int32)), pa.array(cell)], names=["id", "vec", "tree", "cell"]
                )

    placed = rows.mapInArrow(strings, "id bigint, vec array<double>, tree int, cell bigint")
    asking = queries.mapInArrow(strings, "id bigint, vec array<double>, tree int, cell bigint")
    cells = stored(placed.groupBy("tree", "cell").agg(F.count("*").alias("c")))
    # rows below every prefix of every length that a stored cell has
    up = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    prefixes = cells.select("tree", "cell", "c", up).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)"))
    held = prefixes.groupBy("tree", "level", "prefix").agg(F.sum("c").alias("held"))
    asked = asking.select(F.col("id").alias("query_id"), "tree", "cell", up).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)"))
    levels = asked.join(held, ["tree", "level", "prefix"]).groupBy("query_id", "level").agg(F.sum("held").alias("held"))
    levels = stored(levels)
    gather = tune(rows, queries, forest, k, levels)
    # ascend: the longest prefix length with enough rows below, the root if there is none
    reached = levels.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("held") >= gather, F.col("level"))), F.lit(0)).alias("level"))
    blocks = cells.select("tree", "cell", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks"))
    target = asking.withColumnRenamed("id", "query_id").join(reached, "query_id")
    target = target.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)")).select("query_id", "vec", "tree", "level", "prefix")
    span = prefixes.select("tree", "level", "prefix", "cell").join(blocks, ["tree", "cell"])
    sent = target.join(span, ["tree", "level", "prefix"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("tree", "cell", "block", F.lit(True).alias("query"), F.col("query_id").alias("id"), "vec")
    kept = placed.join(blocks, ["tree", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(id, tree), blocks) as int)"))
    kept = kept.select("tree", "cell", "block", F.lit(False).alias("query"), "id", "vec")
    both = kept.unionByName(sent).repartition("tree", "cell", "block").sortWithinPartitions("tree", "cell", "block", "query", "id")
    found = both.mapInArrow(_search(dim, k), "query_id bigint, score double, id bigint")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "id"))), 1, k).alias("top"))
    ranked = top.select("query_id", F.posexplode("top").alias("rank", "r"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("r.id").alias(id_col), F.col("r.score").alias("score"))


def _search(dim: int, k: int):
    """Stream over sorted cells: each holds its rows first and the queries that reach it after them."""

    def cell(part: pa.Table) -> pa.RecordBatch | None:
        query = part.column("query").to_numpy(zero_copy_only=False).astype(bool)
        if query.all() or not query.any():
            return None
        ids, vectors = part.column("id").to_numpy(), matrix(part.column("vec").combine_chunks(), dim)
        rows, row_ids = vectors[~query], ids[~query]
        asking, asking_ids = vectors[query], ids[query]
        found = []
        for at in range(0, len(asking), 256):
            some = nearest(asking[at : at + 256], asking_ids[at : at + 256], rows, row_ids, k)
            found += [(int(asking_ids[at + q]), d, int(row_ids[r])) for q, d, r in some]
        if not found:
            return None
        q, distance, near = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(distance, pa.float64()), pa.array(near, pa.int64())], names=["query_id", "score", "id"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            table = pa.Table.from_batches([*held, batch], schema)
            cut = runs(*(table.column(c).to_numpy() for c in ("tree", "cell", "block")))
            for begin, end in zip(cut[:-2], cut[1:-1], strict=True):
                if (out := cell(table.slice(begin, end - begin))) is not None:
                    yield out
            held = table.slice(cut[-2]).to_batches() if len(cut) > 1 else []
        if held and (out := cell(pa.Table.from_batches(held, schema))) is not None:
            yield out

    return stream
