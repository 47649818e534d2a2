"""Near-duplicate documents by bottom-k sketches, inverted lists and exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import forest, parts_of, stored, words_of
from feedlens.operators.components import connected_components

#: Values kept of each set: the k smallest under one hash function.
SKETCH = 48
#: A linked pair shares at least this many of the keys that its two documents post (fewer if its sets are small).
SHARED = 4
#: Values that a document and its pivot share at least among those they post.
COMPANY = 6
#: Keys held by more documents than this come last in the order of posting.
HOT = 32
#: Values that a document posts to be met by the first document of each list.
PIVOT_VALUES = 24
#: Members that are compared with one copy of their pivot's set.
MEMBERS = 256
#: Ids up to which the filter of documents to read again is broadcast (16 MB); beyond that it is a shuffle join.
BROADCAST_IDS = 2_000_000
#: Rows of the two sides of a block comparison.
LEFT_ROWS, RIGHT_ROWS = 256, 512
#: Chance at most that a pair exactly at the threshold shares fewer sketch values than is assumed.
MISS = 1e-6


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct ``width``-word shingles; the whole sequence if there are fewer words."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(1)).astype(np.int64)


def least_shared(k: int, percent: int) -> int:
    """Overlap of two bottom-k sketches that a pair at the threshold falls short of with chance ``MISS`` at most."""
    p, tail = percent / 100, 0.0
    for x in range(k + 1):
        tail += comb(k, x) * p**x * (1 - p) ** (k - x)
        if tail > MISS:
            return x
    return k


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, n, digest, sketch)``: set size, digest of the whole set (null if empty), bottom-k sketch."""
    kind = dict(docs.dtypes)[id_col]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sizes, digests, kept = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                kept.append(found[:SKETCH].copy())  # a view would keep the whole set
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "sketch"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(sketch, f"id {kind}, n bigint, digest binary, sketch array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, set)`` for the documents named in ``ids``: whole texts, read again."""
    kind = dict(docs.dtypes)[id_col]
    few = ids.count() <= BROADCAST_IDS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return source.mapInArrow(build, f"id {kind}, set binary").dropDuplicates(["id"])


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose full sets reach the threshold.

    The members ``b`` of a hub ``a`` are dealt into blocks of about ``MEMBERS``; the hub's set is
    sent once to each block and leads it, so a task streams over its rows and holds one set.
    """
    kind = dict(pairs.dtypes)["a"]
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.expr("pmod(xxhash64(b), blocks)").alias("block"))
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "set")
    heads = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("id", "a"), "a")
    rows = members.unionByName(heads.select("a", "block", F.lit(None).cast(kind).alias("b"), "set"))
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, dtype=np.int64)
        for batch in batches:
            a, b, sets_ = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            hits = []
            for i in range(batch.num_rows):
                found = np.frombuffer(sets_[i].as_py(), dtype=np.int64)
                if b[i] is None:
                    head = found
                    continue
                if 100 * min(len(found), len(head)) < percent * max(len(found), len(head)):
                    continue
                at = np.searchsorted(head, found)
                at[at == len(head)] = 0
                both = int((head[at] == found).sum()) if len(head) else 0
                if 100 * both >= percent * (len(found) + len(head) - both):
                    hits.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in hits], batch.schema.field(0).type), "b": pa.array([b[i] for i in hits], batch.schema.field(0).type)})

    return rows.mapInArrow(compare, f"a {kind}, b {kind}")


def block_links(candidates: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between documents that met the same pivot, where at least one isn't linked to it.

    ``candidates`` are pairs of pivot and document and ``linked`` those that reach the threshold.
    Documents around a pivot are compared in blocks on their full sets, and a block pair passes on a
    spanning forest of its links only, so near copies that fail the threshold against their
    pivot don't become pairs in a table.
    """
    kind = dict(candidates.dtypes)["a"]
    marked = candidates.join(linked.withColumn("is", F.lit(True)), ["a", "b"], "left").select("a", "b", F.coalesce("is", F.lit(False)).alias("known"))
    counts = marked.groupBy("a").agg(F.count("*").alias("all"), F.count_if(~F.col("known")).alias("open")).where("open > 0")
    counts = counts.select("a", F.ceil(F.col("open") / LEFT_ROWS).alias("nl"), F.ceil(F.col("all") / RIGHT_ROWS).alias("nr"))
    around = marked.join(counts, "a")
    own, other = "pmod(xxhash64(b), {})", "explode(sequence(0L, {} - 1))"
    left = around.where(~F.col("known")).select("a", F.expr(own.format("nl")).alias("i"), F.expr(other.format("nr")).alias("j"), F.lit(1).alias("side"), "b", "known")
    right = around.select("a", F.expr(other.format("nl")).alias("i"), F.expr(own.format("nr")).alias("j"), F.lit(0).alias("side"), "b", "known")
    rows = left.unionByName(right).join(sets.withColumnRenamed("id", "b"), "b").select("a", "i", "j", "side", "b", "known", "set")
    rows = rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "side", "b")

    def compare(cell: list[tuple]) -> list[tuple]:
        side = np.array([r[0] for r in cell])
        sets_ = [np.frombuffer(r[3], dtype=np.int64) for r in cell]
        size = np.array([len(x) for x in sets_])
        right_at = np.flatnonzero(side == 0)
        parent = np.arange(len(cell))
        known = np.flatnonzero(np.array([r[2] for r in cell]))
        parent[known] = known[0] if len(known) else 0
        values = np.concatenate([sets_[k] for k in right_at])
        owner = np.repeat(right_at, size[right_at])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        links: list[tuple[int, int]] = []
        for at in np.flatnonzero(side == 1):
            low, high = np.searchsorted(values, sets_[at]), np.searchsorted(values, sets_[at], side="right")
            many = high - low
            picks = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            both = np.bincount(owner[picks], minlength=len(cell))
            near = (100 * both >= percent * (size + size[at] - both)) & (side == 0) & (both > 0)
            hits = np.flatnonzero(near)
            links += forest(parent, np.full(len(hits), at), hits)
        return [(cell[x][1], cell[y][1]) for x, y in links if cell[x][1] != cell[y][1]]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[tuple] = []
        now, type_ = None, None
        for batch in batches:
            found: list[tuple] = []
            type_ = batch.schema.field(0).type
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for n, key in enumerate(zip(*columns[:3], strict=True)):
                if key != now:
                    found += compare(cell) if cell else []
                    cell, now = [], key
                cell.append((columns[3][n], columns[4][n], columns[5][n], batch.column(6)[n].as_py()))
            yield pairs_batch(found, type_)
        if cell:
            yield pairs_batch(compare(cell), type_)

    def pairs_batch(found: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], type_), pa.array([y for _, y in found], type_)], names=["a", "b"])

    return rows.mapInArrow(stream, f"a {kind}, b {kind}")


def pivot_candidates(sets: DataFrame) -> DataFrame:
    """Pairs of a document and the pivots of the lists it posts to, if they meet in several.

    The pivot of a list is its document with the most company: the highest sum of the lengths of its
    lists, so in a group of near copies the one with the fewest changes of its own. Linear in
    the postings. It links most members of large groups of near copies, so that no later
    step has to pair them with each other.
    """
    posted = sets.select("id", F.explode(F.slice("sketch", 1, PIVOT_VALUES)).alias("v"))
    shared = posted.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    posted = stored(posted.join(shared, "v"))
    scores = posted.groupBy("id").agg(F.sum("c").alias("score"))
    heads = posted.join(scores, "id").groupBy("v").agg(F.min(F.struct(-F.col("score"), F.col("id"))).getField("id").alias("a"))
    met = posted.join(heads, "v").where("id <> a").groupBy("a", "id").agg(F.count("*").alias("c"))
    met = met.join(sets.select("id", "n"), "id").where(F.col("c") >= F.least(F.lit(COMPANY), F.ceil(F.col("n") / 2)))
    return met.select("a", F.col("id").alias("b"))


def keys_of(sketch: Column) -> Column:
    """Retained values in twos: one key for each value with the next one.

    Where neighbours in the order of the union are common to two documents, both have their key; by chance two
    documents share one only if they hold both values and nothing in between.
    """
    return F.zip_with(F.slice(sketch, F.lit(1), F.size(sketch) - 1), F.slice(sketch, F.lit(2), F.size(sketch) - 1), lambda x, y: F.xxhash64(x, y))


def least_keys(k: int, percent: int) -> int:
    """Common neighbours in a union's bottom-k that a pair at the threshold falls short of with chance ``MISS`` at most.

    Each of the k values is common with the threshold's chance; the counts of common neighbours follow
    value by value.
    """
    p = percent / 100
    chance = {(0, False): 1.0}  # by neighbours so far and whether the last value is common
    for _ in range(k):
        after: dict[tuple[int, bool], float] = {}
        for (count, last), q in chance.items():
            after[count + last, True] = after.get((count + last, True), 0.0) + q * p
            after[count, False] = after.get((count, False), 0.0) + q * (1 - p)
        chance = after
    tail = 0.0
    for count in range(k):
        tail += chance.get((count, True), 0.0) + chance.get((count, False), 0.0)
        if tail > MISS:
            return count
    return k - 1


def needed_keys(percent: int) -> Column:
    """Keys that two linked documents share at least, from the set size of one.

    A set that can only meet sets that are kept whole has an exact bound: of u values at most (1 - t) u
    aren't common and each of them parts two pairs of neighbours.
    """
    exact = F.greatest(F.lit(1), F.ceil(F.col("n") * (2 * percent - 100) / 100) - 1)
    return F.when(F.col("n") * 100 <= percent * SKETCH, exact).otherwise(least_keys(SKETCH, percent)).cast("int")


def list_candidates(sets: DataFrame, groups: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups that share enough posted keys and pass the estimate from their union sketch.

    ``sets`` has ``(id, n, sketch)``, ``groups`` the components ``(id, component)`` that are
    known already and ``pivots`` the pivots ``(id, near)`` around which documents have been compared. A key helps
    only if another document holds it; a document with fewer such keys than any partner must share is
    out. Of the others' keys, common ones last, all but the last ``need - SHARED`` are posted: two
    documents that share ``need`` keys share ``SHARED`` posted ones. Within a list, the group with the
    most rows isn't paired with itself.
    """
    documents = sets.select("id", "n", needed_keys(percent).alias("need")).join(groups, "id", "left").withColumn("g", F.coalesce("component", "id"))
    held = sets.select("id", F.explode(keys_of(F.col("sketch"))).alias("v"))
    several = held.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v", (F.col("c") > HOT).alias("hot"))
    useful = held.join(several, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hot", "v"))).alias("vs"))
    useful = useful.join(documents, "id").where(F.size("vs") >= F.col("need")).withColumn("ask", F.least("need", F.lit(SHARED))).join(pivots, "id", "left")
    posted = useful.select("id", "n", "g", "near", "ask", F.expr("explode(slice(vs.v, 1, size(vs) - need + ask))").alias("v"))
    posted = stored(posted)
    lists = posted.groupBy("v", "g").agg(F.count("*").alias("c")).groupBy("v")
    lists = lists.agg(F.max(F.struct("c", "g")).getField("g").alias("most"), F.count("*").alias("gs")).where("gs > 1").select("v", "most")
    told = ("id", "n", "g", "near", "ask")
    right = posted.join(lists, "v").select("v", *[F.col(c).alias(f"{c}2") for c in told], "most")
    left = right.where("g2 <> most").select("v", *[F.col(f"{c}2").alias(f"{c}1") for c in told])
    near = (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (F.col("g1") != F.col("g2"))
    compared = F.coalesce(F.arrays_overlap("near1", "near2"), F.lit(False))
    once = (F.col("g2") == F.col("most")) | (F.col("id1") < F.col("id2"))
    met = left.join(right, "v").where(near & once & ~compared)
    met = met.groupBy(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("ask1", "ask2")).alias("ask"))
    met = stored(met.where("c >= ask").select("a", "b"))
    return estimated(met, sets, percent, least_shared(SKETCH, percent))


def estimated(pairs: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Pairs whose share of common values in the union's bottom-k isn't clearly below the threshold (exact for complete sketches)."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.array_sort(F.array_union("s1", "s2"))
    both = both.withColumn("common", F.array_intersect("s1", "s2")).withColumn("u", union)
    complete = F.greatest("n1", "n2") <= SKETCH
    of_union = F.size(F.array_intersect(F.slice("u", 1, SKETCH), "common"))
    passes = F.when(complete, 100 * F.size("common") >= percent * F.size("u")).otherwise(of_union >= least)
    return both.where(passes).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row, by sets of distinct ``width``-word shingles.

    Two documents are linked if ``100 * intersection >= percent * union``, decided on their full
    sets; ``component_id`` is the smallest id reachable through links and ``kept`` marks the
    document with that id. Documents with equal sets, however many, are one node of the graph.
    A null or empty text, or one without words, has no shingles and links with nothing. A row
    with a null id links with nothing, has a null component and is kept. Rows that repeat an id
    are judged each by its own text. Other columns are ignored; an empty table gives no rows.

    A pair at the threshold is missed with a chance of about ``MISS``, and never if its sets
    have no more than ``SKETCH`` shingles. ``percent`` must be 70 or more: below that, neighbours of small
    sets prove nothing.
    """
    if not 70 <= percent <= 100:
        raise ValueError(f"a threshold lies in 70..100 percent, got {percent}")
    scanned = stored(sketches(docs, id_col, text_col, width))
    filled = F.col("id").isNotNull() & (F.col("n") > 0)
    first = scanned.where(filled).groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("r"))
    sets = stored(first.select("digest", "r.id", "r.n", "r.sketch").repartition("id"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return stored(full_sets(docs, stored(ids), id_col, text_col, width))

    candidates = stored(pivot_candidates(sets))
    candidate_sets = sets_of(candidates)
    by_pivot = stored(linked_pairs(candidates, candidate_sets, percent))
    by_block = stored(block_links(candidates, by_pivot, candidate_sets, percent))
    near = candidates.select(F.col("b").alias("id"), "a").unionByName(candidates.select(F.col("a").alias("id"), "a"))
    near = near.groupBy("id").agg(F.collect_set("a").alias("near"))  # a few: each takes several posted values
    first_links = by_pivot.unionByName(by_block)
    groups = stored(connected_components(first_links).withColumnRenamed("node", "id"))
    by_list = stored(list_candidates(sets.drop("digest"), groups, near, percent))
    by_list = stored(linked_pairs(by_list, sets_of(by_list), percent))
    found = connected_components(first_links.unionByName(by_list)).withColumnRenamed("node", "id")
    named = sets.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    joined = scanned.where(filled).join(named, "digest").select("id", "n", "component_id")
    alone = scanned.where(~filled).select("id", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
