"""Exact top-k over an inverted index in blocks with a bound each, so that most blocks are never scored."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.constants import RETRIEVAL_THRESHOLD, TOP_K
from feedlens.functions.vectors import SIM_DIGITS
from feedlens.session import materialise

#: Tickets of a block on average, at most.
BLOCK_ROWS = 64
#: Above the error of a sum of doubles and of rounding to ``SIM_DIGITS``.
SLACK = 1e-8


@dataclass(frozen=True)
class ImpactIndex:
    """``postings`` is ``(feature, block, pos, value)``, ``bounds`` ``(feature, block, low, high)``, ``blocks`` ``(block, size)``."""

    postings: DataFrame
    bounds: DataFrame
    blocks: DataFrame


@dataclass(frozen=True)
class IndexedTopK:
    """``rows`` is ``(proposal_id, pos, similarity, rank)``, ``work`` ``(proposal_id, blocks, scored)`` of what was looked at."""

    rows: DataFrame
    work: DataFrame


def entries(rows: DataFrame, vec: str, *keep: str) -> DataFrame:
    """``(keep..., feature, value)``, one row per entry of a sparse vector that isn't null or empty."""
    idx, val = rows.schema[vec].dataType.names
    pairs = F.arrays_zip(F.col(f"{vec}.{idx}").alias("feature"), F.col(f"{vec}.{val}").alias("value"))
    return rows.where(F.col(vec).isNotNull()).select(*keep, F.inline(pairs).alias("feature", "value"))


def _bounds(batches):
    """Smallest and largest value of each feature of a block; the entries of a block follow each other."""
    held, last = [], None

    def found():
        table = pa.Table.from_batches(held).group_by(["feature", "block"], use_threads=False).aggregate([("value", "min"), ("value", "max")])
        return table.select(["feature", "block", "value_min", "value_max"]).rename_columns(["feature", "block", "low", "high"]).to_batches()

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        turns = np.flatnonzero(np.diff(blocks)) + 1
        for start, stop in zip([0, *turns], [*turns, len(blocks)], strict=True):
            if stop == start:
                continue
            if held and blocks[start] != last:
                yield from found()
                held = []
            held.append(batch.slice(start, stop - start))
            last = blocks[start]
    if held:
        yield from found()


def build_index(tickets: DataFrame, vec: str = "vec", order: str = "pos", block_rows: int = BLOCK_ROWS) -> ImpactIndex:
    """Index of sparse ticket vectors; ``order`` is a unique ``bigint`` position.

    A block holds tickets that share their heaviest feature, so its largest values are near those of
    its members. A feature that is the heaviest of many tickets has as many blocks as it needs,
    filled by the weight of that feature, so none grows with the table and the first hold the
    highest impacts. Tickets without entries are in no block.
    """
    idx, val = tickets.schema[vec].dataType.names
    rows = materialise(tickets.where(F.col(vec).isNotNull()).select(F.col(order).alias("pos"), F.col(vec).alias("vec")))
    found = F.filter(F.arrays_zip(F.col(f"vec.{idx}").alias("feature"), F.col(f"vec.{val}").alias("value")), lambda e: e["value"] != 0)
    own = F.array_max(F.transform(found, lambda e: F.struct(F.abs(e["value"]).alias("impact"), e["feature"].alias("feature"))))
    heads = rows.select("pos", own.alias("own")).where("own is not null").groupBy("pos").agg(F.max("own").alias("head"))
    heads = materialise(heads.select("pos", F.col("head.feature").alias("head"), F.col("head.impact").alias("impact")))
    # ranges of impact per feature: the sketch of its quantiles has a bounded size for any number of tickets
    quantiles = F.percentile_approx("impact", [i / 64 for i in range(65)], 1000)
    cuts = heads.groupBy("head").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"), quantiles.alias("quantiles"))
    band = F.size(F.filter("quantiles", lambda q: q < F.col("impact")))
    # few parts: by impact alone; more parts than bands: each band is cut further by a hash
    per_band = F.greatest(F.lit(1), F.ceil(F.col("parts") / 65))
    fine = F.pmod(F.xxhash64("pos"), per_band)
    part = F.when(F.col("parts") <= 65, F.floor(band * F.col("parts") / 66)).otherwise(band * per_band + fine)
    dealt = heads.join(cuts, "head").select("pos", (F.col("head").cast("bigint") * F.lit(1 << 31) + part).alias("block"))
    # whole vectors travel and are kept, entries arise within a task; a block lies in one partition, where its bounds are complete before the shuffle
    placed = materialise(rows.join(dealt, "pos").repartition("block").sortWithinPartitions("block"))
    postings = entries(placed, "vec", "block", "pos").where("value <> 0").select("feature", "block", "pos", "value")
    kinds = {c: postings.schema[c].dataType.simpleString() for c in ("feature", "value")}
    schema = f"feature {kinds['feature']}, block bigint, low {kinds['value']}, high {kinds['value']}"
    bounds = materialise(postings.select("feature", "block", "value").mapInArrow(_bounds, schema))
    blocks = materialise(dealt.groupBy("block").agg(F.count("*").alias("size")))
    return ImpactIndex(postings, bounds, blocks)


def _scores(chosen: DataFrame, query: DataFrame, index: ImpactIndex, threshold: float) -> DataFrame:
    """``(proposal_id, pos, similarity)`` at or above the threshold, of all tickets in the chosen ``(proposal_id, block)``."""
    wanted = chosen.select("proposal_id", "block").join(query, "proposal_id")
    met = wanted.join(index.postings, ["feature", "block"])
    dot = F.round(F.sum(F.col("weight") * F.col("value")), SIM_DIGITS)
    return met.groupBy("proposal_id", "pos").agg(dot.alias("similarity")).where(F.col("similarity") >= threshold)


def indexed_top_k(
    proposals: DataFrame, index: ImpactIndex, k: int = TOP_K, threshold: float = RETRIEVAL_THRESHOLD, query_vec: str = "query_vec"
) -> IndexedTopK:
    """The ``k`` most similar tickets of every proposal with similarity >= ``threshold``, which must be above 0.

    The products of a proposal's weights with the largest (or, below zero, smallest) values of a
    block add up to a bound that no ticket of the block exceeds. The blocks with the best bounds that hold
    ``k`` tickets are scored first; their k-th similarity is the proposal's floor, and only blocks whose
    bound reaches it follow. So the answer is exact. Among equal similarities the later ticket ranks first.
    A proposal with a null or empty vector finds nothing. Both rounds are joins on ``(feature,
    block)``: no side is collected, and a task holds no block as a whole.
    """
    if threshold <= 0:
        raise ValueError("tickets without a common feature are in no posting list: the threshold must be above 0")
    query = materialise(entries(proposals, query_vec, "proposal_id").withColumnRenamed("value", "weight").where("weight <> 0"))
    # at most as many as the vectors have dimensions: the rest of the index is read once and not shuffled
    asked = F.broadcast(query.select("feature").distinct())
    index = replace(index, postings=materialise(index.postings.join(asked, "feature", "left_semi")), bounds=index.bounds.join(asked, "feature", "left_semi"))
    most = F.greatest(F.lit(0.0), F.col("weight") * F.col("high"), F.col("weight") * F.col("low"))
    reach = query.join(index.bounds, "feature").groupBy("proposal_id", "block").agg((F.sum(most) + SLACK).alias("bound"))
    reach = reach.where(F.col("bound") >= threshold).join(index.blocks, "block")
    best = Window.partitionBy("proposal_id").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = materialise(reach.withColumn("first", before < k))
    ranked = Window.partitionBy("proposal_id").orderBy(F.desc("similarity"), F.desc("pos"))

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    opened = materialise(top(_scores(reach.where("first"), query, index, threshold)))
    floor = opened.where(F.col("rank") == k).select("proposal_id", F.col("similarity").alias("floor"))
    later = reach.where(~F.col("first")).join(floor, "proposal_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    later = materialise(later.select("proposal_id", "block", "size"))
    rows = top(opened.drop("rank").unionByName(_scores(later, query, index, threshold)))
    looked = reach.where("first").select("proposal_id", "size").unionByName(later.select("proposal_id", "size"))
    work = looked.groupBy("proposal_id").agg(F.count("*").alias("blocks"), F.sum("size").alias("scored"))
    return IndexedTopK(rows, work)
