"""Near-duplicate vectors: binary codes of randomly rotated vectors choose the pairs worth an exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import forest, stored
from feedlens.llm.vectors import matrix, rotation, runs, usable_vectors
from feedlens.operators.components import connected_components

SEED = 20
#: Bits of a code: directions of the random rotation.
CODE_BITS = 256
#: Vectors that share the key bits of a table on average; the number of key bits follows the table's size.
CELL_ROWS = 128
#: Rows of one side of a comparison in a task; larger cells are compared block by block.
BLOCK_ROWS = 1024
#: Chance at most that a pair exactly at the threshold shares no cell.
MISS = 1e-5
#: Confidence of the estimate, in standard deviations of its error.
CONFIDENCE = 7.0


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the factor by which a code falls short of its vector.

    The code of v is the corner of the cube nearest to its rotated vector, scaled to the length
    of that. ``factor`` is their inner product: dividing by it makes the estimate of <v, q> from
    the code unbiased over the rotations.
    """
    turned = unit @ turn.T
    length = np.linalg.norm(turned, axis=1)
    factor = np.abs(turned).sum(axis=1) / (np.sqrt(turn.shape[0]) * length)
    return np.packbits(turned > 0, axis=1), factor


def estimate(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Estimated cosines of rotated unit vectors (rows) with coded vectors (columns)."""
    length = np.linalg.norm(turned, axis=1, keepdims=True)
    return (turned / length) @ signs.T.astype(np.float32) / np.sqrt(np.float32(signs.shape[1])) / factor


def worth_exact(estimated: np.ndarray, factor: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """Pairs whose upper confidence bound reaches the threshold."""
    error = np.sqrt((1 - factor**2) / factor**2 / (bits - 1))
    return estimated + CONFIDENCE * error >= threshold


def _tables(rows: int, bits: int, threshold: float) -> list[np.ndarray]:
    """Positions of each table's key bits behind the ``bits`` of a code: enough tables that a pair at the threshold shares a key in one.

    No two tables share a bit and every bit has its own random direction, so the tables are independent.
    """
    width = max(1, min(20, ceil(log2(max(2, rows / CELL_ROWS)))))
    same = (1 - acos(threshold) / pi) ** width
    count = ceil(log(MISS) / log(1 - same))
    begin = ceil(bits / 8) * 8
    return [begin + np.arange(t * width, (t + 1) * width) for t in range(count)]


def key_bits(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Packed signs of the unit vectors along the directions of all tables' keys."""
    parts = [np.packbits(unit[at : at + BLOCK_ROWS] @ directions.T > 0, axis=1) for at in range(0, len(unit), BLOCK_ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, ceil(len(directions) / 8)), np.uint8)


def key_directions(tables: list[np.ndarray], dim: int) -> np.ndarray:
    """An independent Gaussian direction for every key bit: each tells a pair apart with chance angle / pi, whatever the others do."""
    return np.random.default_rng(SEED + 1).standard_normal((sum(map(len, tables)), dim))


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, bits: int = CODE_BITS
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row, linking vectors with cosine of at least ``threshold``.

    Equal vectors are one node that stands for all its rows. Every node is coded once, with key
    bits of its own for each table, where it lies in the cell of those bits. Within a cell the codes and their factors estimate
    all cosines, and the pairs whose confidence bound reaches the threshold are computed in double
    precision from the stored vectors. A pair counts in the first table where it meets, so links
    are counted without listing pairs; each cell passes on the counts and a spanning forest of
    its links. Cells above ``BLOCK_ROWS`` are compared block against block.

    Vectors that are null, zero, of another length than most or hold null or non-finite components,
    and rows with a null id, link with nothing: no links, their own component, kept. Rows that
    repeat an id with an equal vector count as one another's links. Other columns are ignored.
    """
    kind = dict(df.dtypes)[id_col]
    usable, dim = usable_vectors(df, id_col, vec_col)
    keyed = usable.withColumn("digest", F.xxhash64("vec", F.lit(1))).withColumn("digest2", F.xxhash64(F.lit(2), "vec"))
    nodes = keyed.groupBy("digest", "digest2").agg(F.min(F.struct("id", "vec")).alias("r"), F.count("*").alias("w"))
    turn = rotation(bits, dim, SEED) if dim else np.zeros((bits, 1))
    tables = _tables(keyed.select("digest", "digest2").distinct().count(), bits, threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = key_directions(tables, dim)
        for batch in batches:
            vectors = matrix(batch.column(1), dim)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            packed, factor = encode(unit, turn)
            # stored once: a sign near zero might come out otherwise when computed again among other rows
            coded = pa.array([p.tobytes() for p in np.concatenate((packed, key_bits(unit, directions)), axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, coded, pa.array(factor.astype(np.float32))], names=["id", "vec", "w", "digest", "digest2", "code", "factor"])

    coded = nodes.select("r.id", "r.vec", "w", "digest", "digest2").mapInArrow(
        code, f"id {kind}, vec array<double>, w bigint, digest bigint, digest2 bigint, code binary, factor float"
    )
    coded = stored(coded)
    counts, edges = _compare(coded, tables, turn, dim, bits, threshold, kind)
    found = connected_components(edges).withColumnRenamed("node", "id")
    named = coded.select("id", "w", "digest", "digest2").join(counts, "id", "left").join(found, "id", "left")
    named = named.select("digest", "digest2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = keyed.select("id", "digest", "digest2").join(named, ["digest", "digest2"]).select("id", "n_links", "component_id")
    used = usable.select("id").distinct()
    alone = df.select(F.col(id_col).alias("id")).join(used, "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _compare(coded: DataFrame, tables: list[np.ndarray], turn: np.ndarray, dim: int, bits: int, threshold: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """Links per node, and edges of a spanning forest of each cell's links."""
    placed = coded.select("id", "vec", "w", "code", "factor").mapInArrow(_place(tables), _PLACED.format(kind))
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    sizes = sizes.select("t", "key", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks"))
    cells = placed.join(sizes, ["t", "key"]).withColumn("block", F.expr("cast(pmod(xxhash64(id, t), blocks) as int)"))
    # block i meets block j in cell part (i, j) with i <= j
    mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    parts = cells.withColumn("m", F.explode(mates)).select("t", "key", "m.i", "m.j", "block", "id", "w", "code", "factor", "vec")
    parts = parts.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "block", "id")
    result = stored(parts.mapInArrow(_links(tables, turn, dim, bits, threshold), f"a {kind}, b {kind}, links bigint"))
    counts = result.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return counts, result.where("b is not null").select("a", "b")


_PLACED = "t int, key bigint, id {}, w bigint, code binary, factor float, vec array<double>"


def _keys(bits_of: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Key of each row in each table, from unpacked bits."""
    return np.stack([bits_of[:, t].astype(np.int64) @ (1 << np.arange(len(t), dtype=np.int64)) for t in tables], axis=1)


def _unpacked(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1)


def _place(tables: list[np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_unpacked(batch.column(3)), tables)
            for t in range(len(tables)):
                ids, vec, w, code, factor = batch.columns
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(keys[:, t]), ids, w, code, factor, vec],
                    names=["t", "key", "id", "w", "code", "factor", "vec"],
                )

    return place


def _links(tables: list[np.ndarray], turn: np.ndarray, dim: int, bits: int, threshold: float):
    """Compare the two blocks of every cell part in a stream of sorted rows."""

    def compare(t: int, part: pa.Table, same_block: bool) -> tuple[list, list, list]:
        block = part.column("block").to_numpy()
        vectors = matrix(part.column("vec").combine_chunks(), dim)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        on = _unpacked(part.column("code").combine_chunks())
        factor = part.column("factor").to_numpy().astype(np.float64)
        signs = (2 * on[:, :bits].astype(np.int8) - 1)
        left = np.arange(len(block)) if same_block else np.flatnonzero(block == block[0])
        right = left if same_block else np.flatnonzero(block != block[0])
        if not len(right):
            return [], [], []
        turned = (unit[left] @ turn.T).astype(np.float32)
        maybe = worth_exact(estimate(turned, signs[right], factor[right].astype(np.float32)), factor[right], bits, threshold)
        if same_block:
            maybe = np.triu(maybe, 1)
        i, j = np.nonzero(maybe)
        i, j = left[i], right[j]
        links = np.zeros(len(block), dtype=np.int64)
        parent = np.arange(len(block))
        weight = part.column("w").to_numpy()
        keys = _keys(on, tables[:t]) if t else None
        edges: list[tuple[int, int]] = []
        for at in range(0, len(i), 1 << 16):  # bounded memory for the exact products
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            exact = np.einsum("nd,nd->n", unit[a], unit[b]) >= threshold
            a, b = a[exact], b[exact]
            if keys is not None:  # counted already where an earlier table brought the two together
                new = np.ones(len(a), dtype=bool)
                for s in range(t):
                    new &= keys[a, s] != keys[b, s]
                a, b = a[new], b[new]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            edges += forest(parent, a, b)
        ids = part.column("id").to_pylist()
        some = np.flatnonzero(links)
        first = [ids[k] for k in some] + [ids[a] for a, _ in edges]
        second = [None] * len(some) + [ids[b] for _, b in edges]
        return first, second, links[some].tolist() + [0] * len(edges)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema: pa.Schema | None = None

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            t, i, j = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
            a, b, links = compare(t, rows, i == j)
            if a:
                kind = rows.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(links, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            schema = batch.schema
            table = pa.Table.from_batches([*held, batch], schema)
            cut = runs(*(table.column(c).to_numpy() for c in ("t", "key", "i", "j")))
            for begin, end in zip(cut[:-2], cut[1:-1], strict=True):
                yield from flush(table.slice(begin, end - begin))
            held = table.slice(cut[-2]).to_batches() if len(cut) > 1 else []
        if held:
            yield from flush(pa.Table.from_batches(held, schema))

    return stream
