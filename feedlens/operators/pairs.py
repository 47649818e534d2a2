"""Exact similarity self-joins: all pairs at or above a threshold, or a forest which spans them.

Neither join compares everything with everything in one place:

* dense vectors are partitioned around pivots; a row also goes to a foreign pivot only if the
  triangle inequality on angles allows a match there;
* of sparse vectors chunks of rows meet in pairs. A pair of chunks adds up the products of common rare
  features, bounds those of all others from the norms of groups of features, and computes the few
  pairs of rows whose bound reaches the threshold on the whole vectors. No chunk is copied or shuffled for it.

Buckets and tables of any size are cut into cells of bounded size. With ``forest=True`` a cell
emits a maximum spanning forest of its matches, at most one edge per row, instead of every
pair. Such edges give the same connected components at every threshold not below the given
one, so groups of near copies never produce a quadratic number of rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import vectors as V
from feedlens.operators.encode import TextEncoder
from feedlens.session import materialise, small_batches

CELL_ROWS = 1024
MAX_PIVOTS = 256
#: Rows dealt to pivots at a time; at a low threshold each of them becomes a row per pivot.
ASSIGN_ROWS = 256
#: Sparse join: a chunk holds at most so many rows and entries of whole vectors; chunks lie in at most so many partitions; so many bytes of them are held by a task.
BLOCK_ROWS, BLOCK_ENTRIES, MOST_PARTS, HELD_BYTES = 1 << 16, 1 << 19, 128, 1 << 24
#: Features in more texts than this aren't multiplied one by one.
HOT_FEATURE = 1 << 16
#: Products made one by one per pair of rows, fewer from the threshold ``HIGH`` on, where bounds are sharper; groups of the other features.
HIGH, SINGLES, LOW_SINGLES, GROUPS = 0.8, 0.4, 2.0, 64
#: Sums of a cell held at a time, the rows they take at least, and products made at a time.
STRIP_SUMS, STRIP_ROWS, STRIP_PRODUCTS = 1 << 19, 32, 1 << 15
#: What bounds allow for, besides the rounding of sums to single precision.
SLACK = 1e-5
_PAIRS = "a bigint, b bigint, similarity double"
RANKED = "id bigint, f array<int>, w array<double>, kept int, tail double"
_RANKED = ["id", "f", "w", "kept", "tail"]
_ARRAYS = ["id", "size", "kept", "tail", "f", "w", "alone", "norms"]
CHUNK = f"chunk bigint, inner boolean, {', '.join(f'{c} binary' for c in _ARRAYS)}"
_EMPTY = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})


def spanning_forest(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Indices of a maximum spanning forest of the weighted edges of one cell."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root, keep = list(range(len(nodes))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.lexsort((b, a, -s)):
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
            if len(keep) == len(nodes) - 1:  # everything is connected, the rest adds nothing
                break
    return np.array(keep, dtype=np.int64)


def cell_pairs(rows: pa.Table, threshold: float, forest: bool) -> pa.Table:
    """Matches between the left and the right rows of one cell (or within it, on the diagonal)."""
    rows = rows.combine_chunks()
    left, right = rows.column("as_left").to_numpy(), rows.column("as_right").to_numpy()
    ids = rows.column("id").to_numpy()
    at_l, at_r = np.flatnonzero(left), np.flatnonzero(right)
    if not len(at_l) or not len(at_r):
        return _EMPTY
    sim = V.similarity(*(V.Rows(rows.column("vec").take(pa.array(at))) for at in (at_l, at_r)))
    hit_l, hit_r = np.nonzero(sim >= threshold)
    a, b, s = ids[at_l[hit_l]], ids[at_r[hit_r]], sim[hit_l, hit_r]
    a, b = np.minimum(a, b), np.maximum(a, b)
    fresh = a < b
    if (left & right).any():  # a diagonal cell sees each pair twice
        fresh &= ids[at_l[hit_l]] < ids[at_r[hit_r]]
    a, b, s = a[fresh], b[fresh], s[fresh]
    if forest and len(a):
        kept = spanning_forest(a, b, s)
        a, b, s = a[kept], b[kept], s[kept]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s)], names=["a", "b", "similarity"])


def _join_in_cells(rows: DataFrame, bucket: str, threshold: float, forest: bool, cell_rows: int) -> DataFrame:
    """Match ``inner`` rows of each bucket with all rows of the bucket, in cells of bounded size.

    ``rows`` is ``(bucket, id, vec, inner)``. Inner rows form blocks 0..n-1, the others blocks
    n..m-1; the cells are (left inner block, right block) with left <= right.
    """
    size = rows.groupBy(bucket).agg(
        F.sum(F.col("inner").cast("bigint")).alias("n_in"), F.sum((~F.col("inner")).cast("bigint")).alias("n_out")
    )
    size = size.select(
        bucket,
        F.ceil(F.col("n_in") / cell_rows).cast("int").alias("b_in"),
        F.ceil(F.col("n_out") / cell_rows).cast("int").alias("b_out"),
    ).where("b_in > 0")
    sized = rows.join(size, bucket)
    spot = F.abs(F.xxhash64("id", F.lit(7)) % F.lit(1 << 40))
    blocks = F.col("b_in") + F.col("b_out")
    block = F.when(F.col("inner"), spot % F.col("b_in")).otherwise(F.col("b_in") + spot % F.greatest("b_out", F.lit(1)))
    sized = sized.withColumn("block", block.cast("int")).withColumn("blocks", blocks)
    at = F.col("block")
    as_left = F.when(
        F.col("inner"), F.transform(F.sequence(at, F.col("blocks") - 1), lambda r: F.struct(at.alias("l"), r.alias("r")))
    ).otherwise(F.array().cast("array<struct<l:int,r:int>>"))
    last_left = F.when(F.col("inner"), at - 1).otherwise(F.col("b_in") - 1)
    as_right = F.when(
        last_left >= 0, F.transform(F.sequence(F.lit(0), last_left), lambda x: F.struct(x.alias("l"), at.alias("r")))
    ).otherwise(F.array().cast("array<struct<l:int,r:int>>"))
    cells = sized.select(bucket, "id", "vec", "block", F.explode(F.concat(as_left, as_right)).alias("cell"))
    cells = cells.select(
        bucket, "cell", "id", "vec",
        (F.col("cell.l") == F.col("block")).alias("as_left"),
        (F.col("cell.r") == F.col("block")).alias("as_right"),
    )
    return cells.groupBy(bucket, "cell").applyInArrow(lambda t: cell_pairs(t, threshold, forest), _PAIRS)


def dense_pairs(
    vectors: DataFrame,
    threshold: float,
    id: str = "pos",
    vec: str = "embedding",
    forest: bool = False,
    cell_rows: int = CELL_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """``(a, b, similarity)`` with a < b for dense **unit** vectors.

    A pivot partition receives its own rows and those foreign rows y with
    angle(y, pivot) <= angle(y, own pivot) + 2 * angle(threshold): any x of the partition
    which matches y implies that bound. A pair is found at the lower of its two pivots.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vec).alias("vec")).where("vec is not null")
    n_pivots = max(1, min(max_pivots, rows.count() // cell_rows))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toArrow()
    if not picked.num_rows:
        return vectors.sparkSession.createDataFrame([], _PAIRS)
    shared = vectors.sparkSession.sparkContext.broadcast(V.Rows(picked.column("vec")).dense)
    reach = 2.0 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def assign(batches):
        pivots = shared.value
        for batch in (whole.slice(at, ASSIGN_ROWS) for whole in batches for at in range(0, whole.num_rows, ASSIGN_ROWS)):
            angle = np.arccos(np.clip(V.Rows(batch.column("vec")).dense @ pivots.T, -1.0, 1.0))
            home = angle.argmin(axis=1)
            own = angle[np.arange(len(home)), home]
            go = angle <= own[:, None] + reach
            go &= np.arange(len(pivots))[None, :] <= home[:, None]
            row, pivot = np.nonzero(go)
            out = pa.table(
                [pa.array(pivot, pa.int32()), batch.column("id").take(pa.array(row)),
                 batch.column("vec").take(pa.array(row)), pa.array(pivot == home[row])],
                names=["bucket", "id", "vec", "inner"],
            )
            yield from out.to_batches()

    kind = rows.schema["vec"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"bucket int, id bigint, vec {kind}, inner boolean")
    return _join_in_cells(placed, "bucket", threshold, forest, cell_rows)


def _ranked(rows: DataFrame, encoder: TextEncoder, threshold: float) -> DataFrame:
    """``(id, f, w, kept, tail)``: whole vectors by rank, rarest feature first; the first ``kept`` entries are the prefix, ``tail`` is the norm of what follows it."""
    counts = encoder.counts.value
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    ranks = rows.sparkSession.sparkContext.broadcast(rank)

    def scan(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CELL_ROWS):
                part = batch.slice(start, CELL_ROWS)
                v = V.Rows(part.column("vec"))
                owner = np.repeat(np.arange(v.n), np.diff(v.offsets))
                f = ranks.value[v.idx]
                order = np.lexsort((f, owner))
                f, w = f[order], v.w[order]
                square = w * w
                ahead = np.concatenate([[0.0], np.cumsum(square)])
                rest = np.sqrt(np.maximum(ahead[v.offsets[1:]][owner] - ahead[1:], 0.0))
                keep = np.sqrt(np.maximum(rest**2 + square, 0.0)) >= threshold - 1e-6
                size = np.bincount(owner[keep], minlength=v.n)
                tail = np.full(v.n, np.inf)
                np.minimum.at(tail, owner[keep], rest[keep])
                some = pa.array(size > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").filter(some), V.list_array(v.offsets, f, pa.int32()).filter(some),
                     V.list_array(v.offsets, w, pa.float64()).filter(some), pa.array(size, pa.int32()).filter(some), pa.array(tail).filter(some)],
                    ["id", "f", "w", "kept", "tail"],
                )

    return rows.select("id", "vec").where("id is not null and vec is not null").mapInArrow(scan, RANKED)


def _prefixes(rows: DataFrame, encoder: TextEncoder, threshold: float) -> DataFrame:
    """The rows of ``_ranked``, cut after their prefixes."""
    return _ranked(rows, encoder, threshold).withColumns({c: F.slice(c, F.lit(1), F.col("kept")) for c in "fw"})


def _packed(ranked: DataFrame, inner: bool, most_rows: int, rare: int, only: np.ndarray | None = None) -> DataFrame:
    """Chunks of rows of ``_ranked``, one row each with its arrays as bytes; with ``only``, of rows with one of these features in their prefix.

    Ranks below ``rare`` are those whose products are made one by one; of the others a row has its norms by group of features.
    """
    asked = None if only is None else ranked.sparkSession.sparkContext.broadcast(only)

    def pack(batches):
        from pyspark import TaskContext

        made, held, rows, entries = TaskContext.get().partitionId() << 32, [], 0, 0

        def chunk():
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            columns = [pa.array([x.tobytes()], pa.binary()) for x in arrays]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([inner]), *columns], ["chunk", "inner", *_ARRAYS])

        for batch in (whole.slice(at, CELL_ROWS) for whole in batches for at in range(0, whole.num_rows, CELL_ROWS)):
            if asked is not None and batch.num_rows:
                starts, f = V.list_parts(batch.column("f"))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                reached = asked.value[f] & (np.arange(len(f)) - starts[owner] < batch.column("kept").to_numpy()[owner])
                batch = batch.filter(pa.array(np.bincount(owner[reached], minlength=batch.num_rows) > 0))
            starts, f = V.list_parts(batch.column("f"))
            w = V.list_parts(batch.column("w"))[1]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            alone = np.bincount(owner[f < rare], minlength=batch.num_rows).astype(np.int32)
            rest = np.flatnonzero(f >= rare)
            norms = np.sqrt(np.bincount(owner[rest] * GROUPS + f[rest] % GROUPS, w[rest] ** 2, batch.num_rows * GROUPS)).astype(np.float32).reshape(-1, GROUPS)
            rows_of = [batch.column("id").to_numpy(), np.diff(starts).astype(np.int32), batch.column("kept").to_numpy(), batch.column("tail").to_numpy()]
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(starts, starts[at] + BLOCK_ENTRIES - entries, side="right")) - 1
                stop = min(max(stop, at + (rows == 0)), at + most_rows - rows, batch.num_rows)
                if stop > at:
                    cut = slice(starts[at], starts[stop])
                    held.append([*(x[at:stop] for x in rows_of), f[cut], w[cut], alone[at:stop], norms[at:stop]])
                    rows, entries = rows + stop - at, entries + int(starts[stop] - starts[at])
                if stop < batch.num_rows:  # the chunk is full
                    yield chunk()
                    made, held, rows, entries = made + 1, [], 0, 0
                at = stop
        if held:
            yield chunk()

    return ranked.mapInArrow(pack, CHUNK)


class _Chunk:
    """A chunk of ``_packed``: row r has the entries ``starts[r]`` to ``starts[r + 1]`` of ``rank`` and ``weight``, the first ``alone[r]`` of them with
    a rare feature; ``norms`` are those of the others by group, ``missing`` that of what the row was cut off."""

    def __init__(self, batch: pa.RecordBatch, side: str, row: int):
        kinds = (np.int64, np.int32, np.int32, np.float64, np.int32, np.float64, np.int32, np.float32)
        parts = [np.frombuffer(batch.column(side + c)[row].as_buffer(), kind) for c, kind in zip(_ARRAYS, kinds, strict=True)]
        self.id, size, kept, tail, self.rank, self.weight, self.alone, norms = parts
        self.n = len(self.id)
        self.starts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.norms = norms.reshape(self.n, -1)
        self.missing = np.where(kept == size, tail, 0.0).astype(np.float32)
        self.longest = int(size.max(initial=0))
        self._listed = None

    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and weight of the entries with rare features, row by row."""
        ahead = np.concatenate([[0], np.cumsum(self.alone, dtype=np.int64)])
        row = np.repeat(np.arange(self.n), self.alone)
        at = np.arange(ahead[-1]) + np.repeat(self.starts[:-1] - ahead[:-1], self.alone)
        return row, self.rank[at], self.weight[at].astype(np.float32)

    def lists(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the rows of every rare feature begin, these rows and their weights."""
        if self._listed is None:
            row, f, w = self.rare()
            by_feature = np.sort((f.astype(np.int64) << 32) | np.arange(len(f))) & 0xFFFFFFFF
            ends = np.concatenate([[0], np.cumsum(np.bincount(f, minlength=width))]).astype(np.int32)
            self._listed = ends, row[by_feature].astype(np.int32), w[by_feature]
        return self._listed


    def behind(self, rows: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
        """Norms of what the rows have behind these ranks, with what they were cut off."""
        key = np.repeat(np.arange(self.n) * width, np.diff(self.starts)) + self.rank
        ahead = np.concatenate([[0.0], np.cumsum(self.weight**2)])
        at = np.searchsorted(key, rows * width + rank, side="right")
        return np.sqrt(np.maximum(ahead[self.starts[rows + 1]] - ahead[at], 0.0) + self.missing[rows] ** 2)

    def last(self, rows: np.ndarray) -> np.ndarray:
        return self.rank[self.starts[rows + 1] - 1]


def _rare_ranks(counts: np.ndarray, rows: int, threshold: float, hot_feature: int) -> int:
    """Number of the rarest features whose products are made one by one: so many that two rows have ``SINGLES`` on average, none in more than ``hot_feature`` rows."""
    counts = np.sort(counts)
    share = np.cumsum((counts / max(rows, 1)) ** 2)
    most = SINGLES if threshold >= HIGH else LOW_SINGLES
    return int(min(np.searchsorted(share, most, side="right"), np.searchsorted(counts, hot_feature, side="right")))


def candidates(left: _Chunk, right: _Chunk, same: bool, threshold: float, width: int):
    """Rows of both chunks whose similarity may reach the threshold, a few rows of the right chunk at a time.

    Products of rare features are added up as they are. All other features are dealt to groups, and in a group two rows
    have at most the product of their norms, so a matrix product over the groups bounds what the rare features leave out. Sums are
    single precision, for which the threshold is lowered by more than they can lose.
    """
    ends, owner, w = left.lists(width)
    row, f, x = right.rare()
    first, met = ends[f], np.diff(ends)[f]
    some = np.flatnonzero(met)
    row, x, first, met = row[some], x[some], first[some], met[some]
    products = np.concatenate([[0], np.cumsum(met)])
    at_row = np.searchsorted(row, np.arange(right.n + 1))
    slack = SLACK + np.finfo(np.float32).eps * (min(left.longest, right.longest) + left.norms.shape[1])
    cut = bool(left.missing.max(initial=0) > SLACK or right.missing.max(initial=0) > SLACK)
    norms = np.ascontiguousarray(left.norms.T)
    rows = max(1, min(right.n, max(STRIP_ROWS, STRIP_SUMS // left.n)))
    room = np.empty((rows, left.n), np.float32)
    for start in range(0, right.n, rows):
        stop = min(start + rows, right.n)
        sums = np.matmul(right.norms[start:stop], norms, out=room[: stop - start])
        flat = sums.reshape(-1)
        low, end = at_row[start], at_row[stop]
        while low < end:
            high = int(np.searchsorted(products, products[low] + STRIP_PRODUCTS, side="right")) - 1
            high = min(max(high, low + 1), end)
            n = met[low:high]
            at = np.repeat(first[low:high] - (products[low:high] - products[low]), n)
            at += np.arange(len(at))
            cell = np.repeat((row[low:high] - start) * left.n, n)
            cell += owner[at]
            product = np.repeat(x[low:high], n)
            product *= w[at]
            np.add.at(flat, cell, product)
            low = high
        if cut:
            sums += np.maximum(right.missing[start:stop, None], left.missing[None, :])
        b, a = np.divmod(np.flatnonzero(flat >= np.float32(threshold - slack)), left.n)
        b += start
        once = a < b if same else slice(None)
        yield a[once], b[once]


def _dots(left: _Chunk, right: _Chunk, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Dot products of whole vectors a of the left and b of the right chunk, ordered by b; each row b is laid out once over all features in ``room``."""
    out = np.empty(len(a))
    starts, rank, weight = left.starts.tolist(), left.rank, left.weight
    laid, own = -1, slice(0)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if y != laid:
            room[right.rank[own]] = 0.0
            laid, own = y, slice(right.starts[y], right.starts[y + 1])
            room[right.rank[own]] = right.weight[own]
        part = slice(starts[x], starts[x + 1])
        out[i] = room.take(rank[part]).dot(weight[part])
    room[right.rank[own]] = 0.0
    return np.round(out, V.SIM_DIGITS)


def _met(chunks: DataFrame, threshold: float, width: int, forest: bool, whole: bool = True) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of a row of an inner chunk and any row, a < b, each pair of chunks in one place.

    Inner chunks go to all tasks by broadcast, ``HELD_BYTES`` of them at a time, and meet the chunks that every task reads
    where they lie: nothing is shuffled but what the tasks emit. Of two inner chunks the first meets the second if their distance is even, or else the second
    the first, so that every task has about as much to do.
    Without ``whole`` the pairs are those whose bound reaches the threshold, and their similarity is null.
    """
    spark = chunks.sparkSession
    sizes = chunks.select("chunk", "inner", sum((F.length(c) for c in _ARRAYS), F.lit(0)).cast("bigint").alias("size")).orderBy("chunk").toArrow()
    number = {chunk: i for i, chunk in enumerate(sizes.column("chunk").to_pylist())}
    turns: list[list[int]] = []
    room = 0
    for chunk, inner, size in zip(*(sizes.column(c).to_pylist() for c in ("chunk", "inner", "size")), strict=True):
        if inner:
            if not turns or size > room:
                turns, room = [*turns, []], HELD_BYTES
            turns[-1].append(chunk)
            room -= size
    edges = [_met_with(chunks, held, number, threshold, width, forest, whole) for held in turns]
    if not edges:
        return spark.createDataFrame([], _PAIRS)
    return edges[0] if len(edges) == 1 else materialise(reduce(DataFrame.unionByName, edges).coalesce(MOST_PARTS))


def _met_with(chunks: DataFrame, held: list[int], number: dict[int, int], threshold: float, width: int, forest: bool, whole: bool) -> DataFrame:
    """The pairs of ``_met`` that some chunks make with all that they are to meet."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((chunks.where(F.col("chunk").isin(held)).select("chunk", *_ARRAYS).toArrow(), number))

    def meet(batches):
        table, number = shared.value
        lefts = [(number[batch.column("chunk")[row].as_py()], _Chunk(batch, "", row)) for batch in table.to_batches() for row in range(batch.num_rows)]
        room = np.zeros(width)
        for batch, row in ((batch, row) for batch in batches for row in range(batch.num_rows)):
            own, inner, found = number[batch.column("chunk")[row].as_py()], batch.column("inner")[row].as_py(), []
            right = _Chunk(batch, "", row)
            for other, left in lefts:
                if inner and (other - own) % 2 == (other <= own) and other != own:
                    continue
                for i, j in candidates(left, right, other == own, threshold, width):
                    s = _dots(left, right, i, j, room)
                    if not whole:  # common features that aren't in both lists lie behind the end of the shorter one
                        end = np.minimum(left.last(i), right.last(j))
                        s = np.where(s + left.behind(i, end, width) * right.behind(j, end, width) >= threshold - SLACK, np.nan, -np.inf)
                    a, b = np.minimum(left.id[i], right.id[j]), np.maximum(left.id[i], right.id[j])
                    near = np.flatnonzero((a < b) & ~(s < threshold))
                    if forest and len(near):
                        near = near[spanning_forest(a[near], b[near], s[near])]
                    found.append((a[near], b[near], s[near]))
            a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            if forest and len(found) > 1 and len(a):
                kept = spanning_forest(a, b, s)
                a, b, s = a[kept], b[kept], s[kept]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64(), from_pandas=True)], ["a", "b", "similarity"])

    with small_batches(spark, 1):  # a row is a chunk
        found = materialise(chunks.select("chunk", "inner", *_ARRAYS).mapInArrow(meet, _PAIRS))
    shared.unpersist()
    return found


def _dealt(chunks: DataFrame) -> DataFrame:
    """Chunks in so many partitions that they keep all cores busy and are no more tasks than ``MOST_PARTS``."""
    n, parts = chunks.count(), chunks.rdd.getNumPartitions()
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    if parts < min(n, cores):
        return materialise(chunks.repartition(min(n, 2 * cores)))
    return chunks.coalesce(MOST_PARTS) if parts > MOST_PARTS else chunks


def _candidates(prefixes: DataFrame, threshold: float, width: int, hot_feature: int, block_rows: int) -> DataFrame:
    """Pairs ``(a, b)`` of rows of ``_prefixes`` that pass the bound, each once, a < b."""
    found = prefixes.select(F.explode("f").alias("f")).groupBy("f").count().toArrow()  # as many as the encoder has features
    counts = np.zeros(width, np.int64)
    counts[found.column("f").to_numpy()] = found.column("count").to_numpy()
    rare = _rare_ranks(np.maximum.accumulate(counts), prefixes.count(), threshold, hot_feature)
    chunks = materialise(_packed(prefixes.select(*_RANKED), True, block_rows, rare))
    return _met(_dealt(chunks), threshold, width, False, whole=False).select("a", "b")


def sparse_pairs(
    vectors: DataFrame,
    encoder: TextEncoder,
    threshold: float,
    id: str = "pos",
    vec: str = "vec",
    forest: bool = False,
    hot_feature: int = HOT_FEATURE,
    cell_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(a, b, similarity)`` with a < b for sparse unit vectors of a text encoder.

    Whole vectors are packed into chunks of at most ``cell_rows`` rows, written once. Every two of them meet in a task that adds up
    the products of common rare features in memory, bounds all others by a matrix product, computes the few pairs whose bound reaches the
    threshold on the whole vectors and emits what reaches it. Neither vectors nor candidates are shuffled, so what is written is the vectors
    once and the result, however many chunks there are; reading and computing stay quadratic. Features in more than
    ``hot_feature`` texts never count as rare.
    """
    if threshold <= 0:
        raise ValueError("the prefix bound needs a threshold above 0")
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    rare = _rare_ranks(encoder.counts.value, encoder.n_texts, threshold, hot_feature)
    with small_batches(rows.sparkSession):  # up to three workers of a task hold a batch of vectors
        chunks = materialise(_packed(_ranked(rows, encoder, threshold), True, cell_rows, rare))
    return _met(_dealt(chunks), threshold, encoder.num_features, forest)
