"""Top-k similarity join of proposals and tickets, and the evidence gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.constants import EVIDENCE_THRESHOLD, RETRIEVAL_THRESHOLD, TOP_K
from feedlens.functions import vectors as V

# A block of proposals is sent to every task only up to these sizes; larger sets are blocked.
BROADCAST_PROPOSALS = 1024
BROADCAST_ENTRIES = 2_000_000
TICKETS_PER_BLOCK = 16_384
#: Proposals and tickets of one cell where vectors are dense: larger blocks mean fewer copies of both sides and fewer rows between cells.
DENSE_PROPOSALS, DENSE_TICKETS = 32_768, 65_536
#: Blocks of smaller dense tables, so that the cells keep all cores busy.
LEAST_BLOCKS = (8, 4)
#: Columns of a sparse block that are laid out at a time.
_COLUMNS = 4096
_ROWS = 1024
#: Pairs that reach the floors in a block of rows are computed one by one up to so many times ``k`` per proposal.
_FEW = 2


class ProposalBlock:
    """A bounded set of proposal vectors which scores ticket batches.

    ``within`` are the datasets of the proposals; a ticket of another dataset is out of reach.
    """

    def __init__(self, ids: pa.Array, vectors, within=None):
        self.ids = V.flat(ids)
        self.names = None if within is None else pc.unique(V.flat(within))
        self.codes = None if within is None else pc.index_in(V.flat(within), value_set=self.names).to_numpy(zero_copy_only=False)
        rows = V.Rows(vectors)
        self.n, self.rows = rows.n, rows
        self.features = rows.features() if rows.sparse else None
        self.matrix = None if rows.sparse else rows.block(0, rows.n)
        self.single = None if rows.sparse else np.ascontiguousarray(self.matrix.T, np.float32)
        self.length = 0.0 if rows.sparse else _longest(self.matrix)

    def reaching(self, rows: V.Rows, start: int, stop: int, floor: np.ndarray, most: int):
        """Rows, proposals and similarities of dense vectors at or above the floor of the proposal; None if that may be more than ``most``.

        Products in single precision, with what they can lose, tell the few pairs that are computed in double precision.
        """
        block = rows.block(start, stop)
        if block.shape[1] != self.matrix.shape[1]:
            raise ValueError("vector dimension mismatch")
        lost = 2 * np.finfo(np.float32).eps * (block.shape[1] + 2) * _longest(block) * self.length + 10.0**-V.SIM_DIGITS
        if not np.isfinite(lost):
            return None
        near = np.flatnonzero(block.astype(np.float32) @ self.single >= (floor - lost).astype(np.float32))
        if len(near) > most:
            return None
        at, q = np.divmod(near, self.n)
        s = np.round(np.einsum("ij,ij->i", block[at], self.matrix[q]), V.SIM_DIGITS)
        hit = s >= floor[q]
        return at[hit], q[hit], s[hit]

    def scores(self, rows: V.Rows, start: int, stop: int) -> np.ndarray:
        if rows.sparse:
            shared = np.intersect1d(np.unique(rows.idx[rows.offsets[start] : rows.offsets[stop]]), self.features, assume_unique=True)
            out = np.zeros((stop - start, self.n))
            for lo in range(0, len(shared), _COLUMNS):  # no matrix over all features of the block
                lookup = V.FeatureMap(shared[lo : lo + _COLUMNS])
                width = len(lookup.features)
                out += rows.block(start, stop, lookup, width) @ self.rows.block(0, self.n, lookup, width).T
            return np.round(out, V.SIM_DIGITS)
        block = rows.block(start, stop)
        if block.shape[1] != self.matrix.shape[1]:
            raise ValueError("vector dimension mismatch")
        return np.round(block @ self.matrix.T, V.SIM_DIGITS)

    def reachable(self, within) -> np.ndarray:
        """Tickets x proposals: whether both belong to the same dataset."""
        codes = pc.index_in(V.flat(within), value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        return codes[:, None] == self.codes[None, :]


def _longest(block: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", block, block).max(initial=0.0)))


class BestK:
    """Running top-k tickets of each proposal of a block, with their rows."""

    def __init__(self, block: ProposalBlock, k: int, threshold: float, vec: str, order: str, within: str | None = None):
        self.block, self.k, self.threshold, self.vec, self.order, self.within = block, k, threshold, vec, order, within
        self.floor = np.full(block.n, threshold)
        self.q, self.s, self.o, self.at = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        self.rows: pa.Table | None = None

    def add(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        rows = V.Rows(table.column(self.vec))
        order = table.column(self.order).to_numpy()
        base = self.rows.num_rows if self.rows is not None else 0
        for start in range(0, rows.n, _ROWS):
            stop = min(start + _ROWS, rows.n)
            if not rows.sparse and not self.within:  # once the floors are known few pairs reach them
                few = self.block.reaching(rows, start, stop, self.floor, _FEW * self.k * self.block.n)
                if few is not None:
                    at, q, s = few
                    if len(at):
                        self._merge(q, s, order[start + at], base + start + at)
                    continue
            scores = self.block.scores(rows, start, stop)
            if self.within:
                scores[~self.block.reachable(table.column(self.within).slice(start, stop - start))] = -np.inf
            floor = self.floor
            if stop - start > self.k:
                kth = np.partition(scores, stop - start - self.k, axis=0)[stop - start - self.k]
                floor = np.maximum(floor, kth)
            at, q = np.nonzero((scores >= floor) & (scores > -np.inf))
            if len(at):
                self._merge(q, scores[at, q], order[start + at], base + start + at)
        pool = table if self.rows is None else pa.concat_tables([self.rows, table])
        used, self.at = np.unique(self.at, return_inverse=True)
        self.rows = pool.take(pa.array(used)).combine_chunks()

    def _merge(self, q, s, o, at) -> None:
        """Add pairs; ``at`` numbers the rows held so far and behind them those of the table that is being added."""
        q, s = np.concatenate([self.q, q]), np.concatenate([self.s, s])
        o, at = np.concatenate([self.o, o]), np.concatenate([self.at, at])
        ranked = np.lexsort((-o, -s, q))
        q, s, o, at = q[ranked], s[ranked], o[ranked], at[ranked]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        q, s, o, at = q[keep], s[keep], o[keep], at[keep]
        self.q, self.s, self.o, self.at = q, s, o, at
        held = np.bincount(q, minlength=self.block.n)
        last = np.searchsorted(q, np.arange(self.block.n), side="right") - 1
        full = held >= self.k
        self.floor = np.where(full, np.maximum(self.threshold, s[last]), self.threshold)

    def result(self, schema: pa.Schema) -> pa.Table:
        if self.rows is None:
            return schema.empty_table()
        rows = self.rows.take(pa.array(self.at))
        out = {"proposal_id": self.block.ids.take(pa.array(self.q)), "similarity": pa.array(self.s)}
        columns = [out[f.name] if f.name in out else rows.column(f.name) for f in schema]
        return pa.table(columns, schema=schema)


def _result_schema(proposals: DataFrame, tickets: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = [StructField("proposal_id", proposals.schema["proposal_id"].dataType)]
    fields += [StructField("similarity", DoubleType())]
    fields += [StructField(f.name, f.dataType) for f in tickets.schema]
    spark_schema = StructType(fields)
    return spark_schema, to_arrow_schema(spark_schema)


def retrieve(
    proposals: DataFrame,
    tickets: DataFrame,
    k: int = TOP_K,
    threshold: float = RETRIEVAL_THRESHOLD,
    vec: str = "vec",
    query_vec: str = "query_vec",
    order: str = "pos",
    broadcast_proposals: int = BROADCAST_PROPOSALS,
    within: str | None = None,
) -> DataFrame:
    """The ``k`` most similar tickets of every proposal with similarity >= ``threshold``.

    ``proposals`` has ``proposal_id`` and a unit vector, ``tickets`` has a unit vector and a
    ``bigint`` position. Among equal similarities the later ticket ranks first. Each task
    keeps ``k`` rows per proposal before the shuffle, so what is shuffled does not grow with
    the number of tickets per task. A proposal set above the broadcast limit is cut into
    blocks which meet ticket blocks in a cogroup instead. With ``within``, a text column of both
    sides, a proposal finds only tickets with the same value, so one job serves many datasets.
    """
    tickets = tickets.where(F.col(vec).isNotNull())
    proposals = proposals.select("proposal_id", F.col(query_vec).alias("query_vec"), *([F.col(within).alias("_within")] if within else []))
    proposals = proposals.where("query_vec is not null")
    if within:
        proposals, tickets = proposals.where("_within is not null"), tickets.where(F.col(within).isNotNull())
    spark_schema, arrow_schema = _result_schema(proposals, tickets)
    if k <= 0:
        return tickets.sparkSession.createDataFrame([], spark_schema).withColumn("rank", F.lit(0))

    block = proposals.limit(broadcast_proposals + 1).toArrow()
    if block.num_rows <= broadcast_proposals and _entries(block) <= BROADCAST_ENTRIES:
        found = _scan_with_block(block, tickets, k, threshold, vec, order, within, spark_schema, arrow_schema)
    else:
        found = _block_join(proposals, tickets, k, threshold, vec, order, within, spark_schema, arrow_schema, broadcast_proposals)
    ranked = Window.partitionBy("proposal_id").orderBy(F.desc("similarity"), F.desc(order))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _entries(table: pa.Table) -> int:
    column = V.flat(table.column("query_vec"))
    lists = column.field("idx") if pa.types.is_struct(column.type) else column
    return len(lists.values) if len(lists) else 0


def _best(queries: pa.Table, k, threshold, vec, order, within) -> BestK:
    names = queries.column("_within") if within else None
    return BestK(ProposalBlock(queries.column("proposal_id"), queries.column("query_vec"), names), k, threshold, vec, order, within)


def _scan_with_block(block, tickets, k, threshold, vec, order, within, spark_schema, arrow_schema) -> DataFrame:
    shared = tickets.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        table = shared.value
        if table.num_rows:
            best = _best(table, k, threshold, vec, order, within)
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    best.add(pa.Table.from_batches([batch.slice(at, _ROWS)]))
            yield from best.result(arrow_schema).to_batches()

    return tickets.mapInArrow(scan, spark_schema)


def _block_join(proposals, tickets, k, threshold, vec, order, within, spark_schema, arrow_schema, per_block) -> DataFrame:
    n_proposals, n_tickets = proposals.count(), tickets.count()
    query_blocks, ticket_blocks = (max(1, -(-n // most)) for n, most in ((n_proposals, per_block), (n_tickets, TICKETS_PER_BLOCK)))
    if "idx" not in proposals.schema["query_vec"].dataType.simpleString():
        query_blocks = min(query_blocks, max(LEAST_BLOCKS[0], -(-n_proposals // DENSE_PROPOSALS)))
        ticket_blocks = max(-(-n_tickets // DENSE_TICKETS), min(LEAST_BLOCKS[1], -(-n_tickets // 2048)), 1)

    def all_blocks(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = proposals.withColumn("qb", F.pmod(F.xxhash64("proposal_id"), F.lit(query_blocks)).cast("int"))
    left = left.withColumn("tb", all_blocks(ticket_blocks))
    right = tickets.withColumn("_tb", F.pmod(F.xxhash64(order), F.lit(ticket_blocks)).cast("int"))
    right = right.withColumn("_qb", all_blocks(query_blocks))

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return arrow_schema.empty_table()
        rows, found = rows.drop_columns(["_tb", "_qb"]), []
        for start in range(0, queries.num_rows, per_block):
            best = _best(queries.slice(start, per_block), k, threshold, vec, order, within)
            best.add(rows)
            found.append(best.result(arrow_schema))
        return pa.concat_tables(found)

    return left.groupBy("qb", "tb").cogroup(right.groupBy("_qb", "_tb")).applyInArrow(meet, spark_schema)


def gate(evidence: DataFrame, threshold: float = EVIDENCE_THRESHOLD) -> DataFrame:
    """Keep evidence at or above the threshold. Applied after top-k, so that rejects can be counted."""
    return evidence.where(F.col("similarity") >= threshold)


def gate_counts(proposals: DataFrame, evidence: DataFrame, threshold: float = EVIDENCE_THRESHOLD) -> DataFrame:
    """Retrieved, validated and rejected tickets per proposal, zeros included."""
    counts = evidence.groupBy("proposal_id").agg(
        F.count("*").alias("retrieved"), F.sum((F.col("similarity") >= threshold).cast("bigint")).alias("validated")
    )
    zero = F.lit(0).cast("bigint")
    joined = proposals.select("proposal_id").join(counts, "proposal_id", "left")
    retrieved, validated = F.coalesce("retrieved", zero), F.coalesce("validated", zero)
    return joined.select(
        "proposal_id",
        retrieved.alias("retrieved"),
        validated.alias("validated"),
        F.greatest(zero, retrieved - validated).alias("rejected"),
    )
