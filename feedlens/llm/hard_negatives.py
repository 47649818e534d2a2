"""Hard-negative mining by a vertical scan: dimensions are read one after another and bounds on what is left shrink the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import stored
from feedlens.llm.vectors import matrix

#: Rows of a slab, which one task holds while all anchors pass; a slab of 64 dimensions takes 64 MB.
SLAB_ROWS = 1 << 17
#: Rows of a slab scanned together, with smallest and largest values of their own per dimension.
BLOCK_ROWS = 4096
#: Rows at least for which a slab of its own is worth its overhead.
LEAST_ROWS = 1024
#: Dimensions read between two looks at the bounds.
STEP = 8
#: A window without ends.
OPEN = np.array([1 << 61])
#: Kinds of numbers, narrowest first, with the size up to which all integers are exact.
KINDS = ((np.float32, 1 << 24), (np.float64, 1 << 53), (np.int64, 1 << 64))


class Columns:
    """Rows of a block stored dimension by dimension: their places in the slab, their labels' numbers and their components."""

    def __init__(self, places: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.places, self.labels = places, labels
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.largest = max(abs(int(self.low.min())), abs(int(self.high.max())))
        self.values = np.ascontiguousarray(values.T, dtype=exact_kind(self.largest))


def exact_kind(size: int) -> type:
    """The narrowest kind of number that holds all integers up to ``size``."""
    return next(kind for kind, end in KINDS if size < end)


def scan(columns: Columns, anchor: np.ndarray, bitmap: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, scores)`` of the rows in the ``bitmap`` whose inner product with ``anchor`` may be among the ``most`` highest of a window ``floor..ceiling``.

    Dimensions are read in the order of the anchor's magnitudes. After every few of them each
    row's score lies between what it has so far and the smallest and largest that the remaining
    dimensions of this block can add. A row stays a candidate while that range meets a window above the window's
    floor, which rises to the ``most``-th highest score that rows surely inside it are sure to reach.
    Scores that come back are exact.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    kind = exact_kind(int(np.abs(anchor).max()) * columns.largest * len(anchor))
    q = anchor[order].astype(kind)
    ends = np.stack((columns.low[order].astype(np.int64) * anchor[order], columns.high[order].astype(np.int64) * anchor[order]))
    least, top = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0)))
    bounds = [[int(f), int(c)] for f, c in zip(floors, ceilings, strict=True)]
    score = np.zeros(columns.values.shape[1], dtype=kind)
    rows, whole = None, True  # places of the scores once few candidates are left; before that the bitmap tells them
    for at in range(0, len(q), STEP):
        values = columns.values[order[at : at + STEP]]
        values = values if whole else values.take(rows, axis=1)
        score += q[at : at + STEP] @ values.astype(kind, copy=False)
        # a row's score lies between score + below and score + above
        below, above = int(least[min(at + STEP, len(q))]), int(top[min(at + STEP, len(q))])
        for bound in bounds:
            if bound[1] - bound[0] >= above - below:  # wider than what is open, so rows can be surely inside
                sure = score[between(score, bound[0] - below, bound[1] - above) & bitmap]
                if len(sure) >= most:
                    bound[0] = max(bound[0], int(np.partition(sure, len(sure) - most)[len(sure) - most]) + below)
        bitmap = bitmap & between(score, min(f for f, _ in bounds) - above, max(c for _, c in bounds) - below)
        left = np.count_nonzero(bitmap)
        if not left:
            break
        if left < len(bitmap) // 4:
            rows = np.flatnonzero(bitmap) if whole else rows[bitmap]
            score, bitmap, whole = score[bitmap], np.ones(left, dtype=bool), False
    meets = np.zeros(len(score), dtype=bool)
    for floor, ceiling in bounds:
        meets |= between(score, floor, ceiling)
    meets &= bitmap
    return (np.flatnonzero(meets) if whole else rows[meets]), score[meets].astype(np.int64)


def between(score: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which scores lie from ``low`` to ``high``, whatever the size of the two."""
    end = (1 << 63) - 1
    return (score >= max(-end, min(end, low))) & (score <= max(-end, min(end, high)))


def mine_hard_negatives(
    df: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", label=None,
    positives: int = 5, negatives: int = 3, scale: int = 256, low: int = 50, high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for every anchor and positive.

    A component x becomes ``floor(scale * x)`` and a score is the integer inner product. The
    positives of an anchor are its ``positives`` highest other rows with its label, the negatives
    of a positive the ``negatives`` highest rows of another label that score ``low`` to ``high`` per cent of it.
    Higher scores come first, ties by smaller id. ``label`` replaces the label column where given.

    Rows are dealt by id into slabs of at most ``SLAB_ROWS``, each of which a task keeps as
    columns while the anchors, a stated part of the rows, stream past it in blocks; a task passes on the best of
    its slab per anchor, so results are merged from a bounded number of rows per slab. Labels
    don't decide where a row goes, so a frequent one costs no task more than others.

    No part take rows with a null id, label or vector, with a null or non-finite component, of another
    length than most, or with components so large that a score could leave 64 bits. Zero vectors
    take part. Rows that repeat an id with the same label and vector count once; rows that
    share an id are never each other's positive or negative, and those of them that differ are rows of
    their own. Anchors without positives, and positives without fitting rows, give no rows; an empty
    table gives none. Other columns are ignored.
    """
    id_kind = dict(df.dtypes)[id_col]
    rows, dim = usable_rows(df, is_anchor, id_col, vec_col, F.col(label_col) if label is None else label, scale)
    rows = stored(rows)
    count = rows.count()
    slabs = slab_count(count, rows.sparkSession.sparkContext.defaultParallelism)
    anchors = rows.where("anchor").select("id", "label", "vec", "row")
    found = _pass(rows, anchors.withColumn("windows", F.lit(None).cast(WINDOWS)), slabs, dim, positives, id_kind)
    by_anchor = Window.partitionBy("id", "row").orderBy(F.desc("score"), "other", "other_row")
    found = found.withColumn("n", F.row_number().over(by_anchor)).where(F.col("n") <= positives)
    # exact in decimals whatever the size of the score
    wide = F.col("score").cast("decimal(30,0)")
    window = F.struct(F.ceil(wide * low / 100).cast("long").alias("floor"), F.floor(wide * high / 100).cast("long").alias("ceiling"))
    found = stored(found.select("id", "row", "other", "score", window.alias("window")))
    windows = found.where("window.floor <= window.ceiling").groupBy("id", "row").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    # each window of an anchor gets its own negatives; positives with equal scores share one
    mined = _pass(rows, anchors.join(windows, ["id", "row"]).select("id", "label", "vec", "row", "windows"), slabs, dim, negatives, id_kind)
    by_window = Window.partitionBy("id", "row", "window").orderBy(F.desc("score"), "other", "other_row")
    mined = mined.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    mined = mined.select("id", "row", "window", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("id", "row", "window", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(mined, ["id", "row", "window"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


WINDOWS = "array<struct<floor:bigint,ceiling:bigint>>"


def usable_rows(df: DataFrame, is_anchor, id_col: str, vec_col: str, label, scale: int) -> tuple[DataFrame, int]:
    """``(id, label, vec, anchor, row)`` of the distinct rows that take part, components as integers, and their dimension."""
    kind = dict(df.dtypes)[vec_col]
    if not kind.startswith("array<"):
        raise ValueError(f"{vec_col} must be an array, not {kind}")
    source = df.select(
        F.col(id_col).alias("id"), label.cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("vec") > 0))
    most = source.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 1
    limit = float(min((1 << 31) - 1, isqrt(((1 << 63) - 1) // dim)))
    scaled = F.transform("vec", lambda x: F.lit(float(scale)) * x)
    fits = F.forall(scaled, lambda x: (x >= -limit) & (x < limit))
    source = source.where((F.size("vec") == dim) & fits).select("id", "label", F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("vec"), "anchor")
    once = source.groupBy("id", "label", "vec").agg(F.max("anchor").alias("anchor"))
    return once.withColumn("row", F.xxhash64("id", "label", "vec")), dim


def slab_count(rows: int, cores: int) -> int:
    """Slabs of at most ``SLAB_ROWS`` rows; for small tables as many as keep the cores busy, but of ``LEAST_ROWS`` rows at least."""
    return max(1, ceil(rows / SLAB_ROWS), min(2 * cores, rows // LEAST_ROWS))


def _pass(rows: DataFrame, anchors: DataFrame, slabs: int, dim: int, most: int, id_kind: str) -> DataFrame:
    """Every anchor against every slab: the best rows of its label, or of other labels in each of its windows."""
    none = F.lit(None).cast(WINDOWS)
    kept = rows.select(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(slabs)).cast("int").alias("slab"), F.lit(False).alias("asks"), "id", "label", "vec", "row", none.alias("windows"))
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(True).alias("asks"), "id", "label", "vec", "row", "windows")
    dealt = kept.unionByName(asking).repartitionById(slabs, F.col("slab")).sortWithinPartitions("slab", "asks", "row")
    return dealt.mapInArrow(_scan_slabs(dim, most), f"row bigint, id {id_kind}, window struct<floor:bigint,ceiling:bigint>, other {id_kind}, other_row bigint, score bigint")


class Slab:
    """The rows of a slab in blocks, label by label so that a block has few labels."""

    def __init__(self, held: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(held)
        labels = table.column("label").combine_chunks().dictionary_encode()
        self.label_number = {name: n for n, name in enumerate(labels.dictionary.to_pylist())}
        number = labels.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        ids = table.column("id").combine_chunks()
        self.kind = ids.type
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.id_order = np.unique(self.ids, return_inverse=True)[1]
        self.rows = table.column("row").to_numpy()
        values = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        self.blocks = [Columns(part, number[part], values[part]) for at in range(0, len(order), BLOCK_ROWS) if len(part := order[at : at + BLOCK_ROWS])]

    def positives(self, own, label: str, vec: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        number = self.label_number.get(label, -1)
        return self._best(own, vec, lambda block: block.labels == number, -OPEN, OPEN, most)[0]

    def negatives(self, own, label: str, vec: np.ndarray, windows: list[dict], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        number = self.label_number.get(label, -1)
        floors, ceilings = (np.array([w[k] for w in windows], dtype=np.int64) for k in ("floor", "ceiling"))
        return self._best(own, vec, lambda block: block.labels != number, floors, ceilings, most)

    def _best(self, own, vec, fits, floors, ceilings, most):
        """Per window the ``(places, scores)`` of its best rows, block after block with rising floors."""
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in floors]
        floors = floors.copy()
        for block in self.blocks:
            bitmap = fits(block) & (self.ids[block.places] != own)
            if not bitmap.any():
                continue
            rows, scores = scan(block, vec, bitmap, floors, ceilings, most)
            places = block.places[rows]
            for w, (floor, ceiling) in enumerate(zip(floors, ceilings, strict=True)):
                inside = (scores >= floor) & (scores <= ceiling)
                at, all_scores = np.append(best[w][0], places[inside]), np.append(best[w][1], scores[inside])
                first = np.lexsort((self.rows[at], self.id_order[at], -all_scores))[:most]
                best[w] = at[first], all_scores[first]
                if len(first) == most:
                    floors[w] = max(floor, all_scores[first[-1]])
        return best


def _scan_slabs(dim: int, most: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        slab, number = None, None
        for batch in batches:
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            slabs = batch.column(0).to_numpy()
            for begin, end in _stretches(slabs, asks):
                part = batch.slice(begin, end - begin)
                if slabs[begin] != number:
                    held, slab, number = [], None, slabs[begin]
                if not asks[begin]:
                    held.append(part)
                    continue
                if slab is None and held:
                    slab, held = Slab(held, dim), []
                if slab is not None:
                    yield from _answer(slab, part, dim, most)

    return stream


def _stretches(slabs: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero((slabs[1:] != slabs[:-1]) | (asks[1:] != asks[:-1])) + 1
    edges = [0, *change.tolist(), len(slabs)]
    return [(b, e) for b, e in zip(edges[:-1], edges[1:], strict=True) if e > b]


def _answer(slab: Slab, part: pa.RecordBatch, dim: int, most: int) -> Iterator[pa.RecordBatch]:
    ids = part.column(2).to_numpy(zero_copy_only=False)
    vectors = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
    asked, window, places, scores = [], [], [], []
    for k, (label, windows) in enumerate(zip(part.column(3).to_pylist(), part.column(6).to_pylist(), strict=True)):
        if windows is None:
            answers = [(None, slab.positives(ids[k], label, vectors[k], most))]
        else:
            answers = zip(windows, slab.negatives(ids[k], label, vectors[k], windows, most), strict=True)
        for asked_window, (at, score) in answers:
            asked += [k] * len(at)
            window += [asked_window] * len(at)
            places.append(at)
            scores.append(score)
    if asked:
        at = np.concatenate(places)
        kind = pa.struct([("floor", pa.int64()), ("ceiling", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [part.column(5).take(pa.array(asked)), part.column(2).take(pa.array(asked)), pa.array(window, kind), pa.array(slab.ids[at], slab.kind), pa.array(slab.rows[at]), pa.array(np.concatenate(scores))],
            names=["row", "id", "window", "other", "other_row", "score"],
        )
