"""Order-sensitive fingerprint of a table as a Merkle tree over row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators.number import number_rows
from feedlens.session import materialise

FAN_OUT = 1024


def ordered_fingerprint(rows: DataFrame, text: Column, order: list[str], fan_out: int = FAN_OUT) -> DataFrame:
    """``(n, fingerprint)``: one row that changes when a text changes or two rows swap, whatever the partitions.

    Every row has the md5 of its text (null counts as empty) as a leaf at its position in ``order``. A node
    is the md5 of its ``fan_out`` children's hashes in order, level by level up to a single one, so
    no task holds more than one node's children. An empty table has the md5 of an empty text. Rows that
    tie in ``order`` need a further column there to have one order.
    """
    leaves = rows.select(*order, F.md5(F.coalesce(text, F.lit(""))).alias("h"))
    nodes = materialise(number_rows(leaves, order).select("i", "h"))
    n = nodes.count()
    size = n
    while True:
        children = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda c: c["h"])
        nodes = nodes.groupBy(F.expr(f"i div {fan_out}").alias("i")).agg(F.md5(F.array_join(children, "")).alias("h"))
        size = -(-size // fan_out)
        if size <= 1:
            break
        nodes = materialise(nodes)
    return nodes.agg(F.lit(n).cast("bigint").alias("n"), F.coalesce(F.max("h"), F.md5(F.lit(""))).alias("fingerprint"))
