"""Mixing sources to target weights, with whole documents dealt to output shards. Column expressions only."""

from __future__ import annotations

from math import log, log2, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import stored

SEED = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most this many times.
MOST_REPEATS = 3
#: Words of a block on average (each document counts a few more, so that empty ones fill blocks too), and
#: blocks of the whole table at most: above that blocks grow, for the tree's draws cost the root of their number.
BLOCK_WORDS = 16_384
MOST_BLOCKS = 1 << 18
WORDS_PER_DOCUMENT = 16
#: Output shards; a power of two.
SHARDS = 16
#: Parts into which a shard is cut for its local shuffle.
CUTS = 256
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_SOURCES = 100_000
#: Positions of a permuted order are counted in this many coarse ranges first, then within each.
RANGES = 1024


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``(source, source_size, docs, target)``: sizes shared by weight, no target above ``most`` times its source.

    Sources in code-point order, null last, take the weights in turn. The target of a source is
    its weight times a common level, or its cap where that is lower. Sources are capped in the
    order of cap by weight, so the level follows from running sums. ``sources`` has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    free = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if this source and all behind it stay below their caps; the first for which that holds decides
    table = table.withColumn("level", free / rest)
    fits = F.col("cap") >= F.col("weight") * F.col("level")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return table.select("source", "source_size", "docs", share.cast("double").alias("target"))


# ---- the splitting tree ----


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, where it is exact to 1e-10."""

    def of(x: Column) -> Column:
        series = (x - 0.5) * F.ln(x) - x + 0.5 * log(2 * pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
        return series - F.ln((x - 1) * (x - 2) * (x - 3) * (x - 4)) - F.ln((x - 5) * (x - 6) * (x - 7) * (x - 8))

    return _let(n.cast("double") + 9.0, of)


def _hypergeometric(total: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """A draw from the hypergeometric distribution by inversion of ``uniform``.

    Only counts within 12 standard deviations of the mean are looked at, in the order of the square
    root of the blocks drawn; what lies outside has a chance far below that of a rounding error.
    """

    def bounds(x: Column) -> Column:
        mean = F.when(x.t > 0, x.d * x.g / x.t).otherwise(0.0)
        variance = F.when(x.t > 1, x.d * (x.g / x.t) * (1 - x.g / x.t) * (x.t - x.d) / (x.t - 1)).otherwise(0.0)
        spread = 12 * F.sqrt(F.greatest(F.lit(0.0), variance)) + 2
        low = F.greatest(F.lit(0.0), x.d - (x.t - x.g), F.floor(mean - spread).cast("double"))
        high = F.least(x.g, x.d, F.ceil(mean + spread).cast("double"))
        return F.struct(*[x[n].alias(n) for n in ("t", "g", "d", "u")], mean.alias("mean"), low.alias("low"), high.alias("high"))

    def log_weight(x: Column, k: Column) -> Column:
        return -_log_factorial(k) - _log_factorial(x.g - k) - _log_factorial(x.d - k) - _log_factorial(x.t - x.g - x.d + k)

    def draw(x: Column) -> Column:
        middle = log_weight(x, F.least(F.greatest(F.round(x.mean), x.low), x.high))
        return _let(middle, lambda m: _let(weights(x, m), lambda w: invert(x, w)))

    def weights(x: Column, middle: Column) -> Column:
        counts = F.sequence(x.low.cast("long"), x.high.cast("long"))
        return F.transform(counts, lambda k: F.struct(k.alias("k"), F.exp(log_weight(x, k) - middle).alias("p")))

    def invert(x: Column, w: Column) -> Column:
        every = F.aggregate(w, F.lit(0.0), lambda s, y: s + y.p)
        start = F.struct((x.u * every).alias("left"), x.low.cast("long").alias("k"))
        pick = F.aggregate(w, start, lambda s, y: F.struct((s.left - y.p).alias("left"), F.when(s.left > 0, y.k).otherwise(s.k).alias("k")))
        return pick.k

    named = F.struct(total.cast("double").alias("t"), good.cast("double").alias("g"), draws.cast("double").alias("d"), uniform.alias("u"))
    return _let(named, lambda n: _let(bounds(n), draw))


def shard_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(source_no, upto)``: for each source the running sums of its exact block quotas over the shards.

    ``draws`` has ``(source_no, n)``, the block draws of each source. At each node of a binary tree
    over the shards, the blocks of all sources that have come to it are split into two halves as a
    random deal would: source by source a hypergeometric draw tells how many of its blocks
    go left, conditioned on the seats that are left there. Quotas of the halves add up to those of
    their node, sizes of sibling shards differ by one block at most. Its table is one row per
    node, each an array with a number per source.
    """
    node = draws.groupBy().agg(F.array_sort(F.collect_list(F.struct("source_no", "n"))).alias("has")).where(F.size("has") > 0)
    node = node.select(F.lit(0).alias("node"), "has")
    for depth in range(int(log2(shards))):

        def split(state: Column, item: Column) -> Column:
            """One source at a node: how many of its blocks go to the left half."""
            uniform = (F.pmod(F.xxhash64(F.lit(seed), state.depth, state.node, item.source_no), F.lit(1 << 40)) + 0.5) / float(1 << 40)
            drawn = _hypergeometric(state.total, item.n, state.seats, uniform)
            return _let(drawn, lambda left: after(state, item, left))

        def after(state: Column, item: Column, left: Column) -> Column:
            return F.struct(
                state.node.alias("node"),
                state.depth.alias("depth"),
                (state.total - item.n).alias("total"),
                (state.seats - left).alias("seats"),
                F.concat(state.out, F.array(F.struct(item.source_no.alias("source_no"), left.alias("n")))).alias("out"),
            )

        total = F.aggregate("has", F.lit(0).cast("long"), lambda s, x: s + x.n)
        empty = F.array().cast("array<struct<source_no:int,n:bigint>>")
        # an odd block goes left or right by the node's own coin
        half = F.floor((total + F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(depth), "node"), F.lit(2))) / 2)
        begin = F.struct(F.col("node"), F.lit(depth).alias("depth"), total.alias("total"), half.alias("seats"), empty.alias("out"))
        node = node.withColumn("left", F.aggregate("has", begin, split, lambda s: s.out))
        right = F.zip_with("has", "left", lambda h, x: F.struct(h.source_no.alias("source_no"), (h.n - x.n).alias("n")))
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("has")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("has")))
        node = stored(node.select(F.explode(halves).alias("h")).select("h.node", "h.has"))
    leaves = node.select("node", F.inline("has")).groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("q"))
    running = F.aggregate(
        "q", F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(x.n + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long"))))
    )
    return leaves.select("source_no", running.alias("upto"))


# ---- blocks and documents ----


def _with_position(blocks: DataFrame) -> DataFrame:
    """Position and words before each block in its source's permuted order, by coarse ranges and then within each."""
    ranged = blocks.withColumn("range", F.pmod(F.shiftrightunsigned("order", 40), F.lit(RANGES)).cast("int"))
    sums = ranged.groupBy("source_no", "range").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"))
    within = Window.partitionBy("source_no", "range").orderBy("order", "block")
    words = F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumns({"n1": F.row_number().over(within) - 1, "w1": F.coalesce(words, F.lit(0))})
    placed = placed.join(sums, ["source_no", "range"])
    return placed.select("source_no", "block", "words", (F.col("n0") + F.col("n1")).alias("position"), (F.col("w0") + F.col("w1")).alias("before"))


#: Two hashes of id, source and text, together 128 bits and never null: equal only in rows that agree in all three.
KEYS = ("key_0", "key_1")


def row_keys(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """The two hashes; whether a column is null counts too."""
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c).cast("string"), F.col(c).isNull())]
    return [F.xxhash64(F.lit(n), *parts).alias(name) for n, name in enumerate(KEYS)]


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """``(id, source, size, source_size, target, repeats, taken, shards)``, one row per document.

    The documents of a source are dealt into blocks by hash and the blocks put into a permuted
    order. A source whose target is r times its size is taken floor(r) times as a whole, and then
    block by block in that order up to the block in which the rest ends; of that block the
    documents are taken in permuted order as long as they bring the sum nearer to the target. ``taken``
    is ``repeats`` times the document's words. ``shards`` names the output shard of each time: the
    splitting tree deals the block draws of all sources into equal shards with exact quotas, and
    a source's draws fill its quotas in permuted order, full passes first.

    Nothing depends on partitions or time, so reruns agree. A null text has size 0, a null source
    is a source of its own, null ids and repeated rows are kept (repeated rows are taken alike).
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    seeded = F.lit(seed)
    order = F.xxhash64(seeded, F.col(id_col).cast("string"), source_col, "size", F.lit("document"))
    sized = docs.select(F.col(id_col), F.col(source_col), word_count(text_col).alias("size"), *row_keys(id_col, source_col, text_col))
    sized = stored(sized.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size", order.alias("order"), *KEYS))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    shares = targets(totals, weights, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.col("source_size") + WORDS_PER_DOCUMENT * F.col("docs")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    block_words = F.greatest(F.lit(float(BLOCK_WORDS)), F.sum(weight).over(Window.partitionBy()) / MOST_BLOCKS)
    shares = shares.withColumns({"blocks": F.ceil(weight / block_words).cast("long"), "passes": passes})
    shares = stored(shares.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    small = shares.count() <= BROADCAST_SOURCES
    told = F.broadcast(shares) if small else shares
    of_source = sized["source"].eqNullSafe(told["source"])
    placed = sized.join(told, of_source).select("id", sized["source"], "size", "order", *KEYS, "source_no", "source_size", "target", F.pmod("order", F.col("blocks")).alias("block"))
    blocks = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("order", F.xxhash64(seeded, "source_no", "block", F.lit("block")))
    plan = _with_position(blocks).join(told.select("source_no", "passes", "rest", "blocks"), "source_no")
    more = (F.col("before") < F.col("rest")) & (F.col("words") > 0)
    # words still wanted when the block's turn comes; 0 or less: the block is not taken again
    plan = stored(plan.withColumn("wanted", F.when(more, F.col("rest") - F.col("before")).otherwise(0.0)))
    drawn = plan.groupBy("source_no").agg(F.sum(F.col("passes") + (F.col("wanted") > 0).cast("long")).cast("long").alias("n"))
    quotas = shard_quotas(drawn.select(F.col("source_no").cast("int"), "n"), shards, seed)
    quotas = F.broadcast(quotas) if small else quotas
    ranks = F.when(F.col("passes") + (F.col("wanted") > 0).cast("long") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes") + (F.col("wanted") > 0).cast("long") - 1), lambda e: e * F.col("blocks") + F.col("position")
    )).otherwise(F.array().cast("array<bigint>"))
    plan = plan.join(quotas, "source_no").withColumn("ranks", ranks)
    seats = F.transform("ranks", lambda r: F.size(F.filter("upto", lambda u: u <= r)))
    plan = plan.select("source_no", "block", "passes", "wanted", seats.alias("seats"))
    # documents of a block in permuted order: taken once more while that brings the sum nearer
    turn = Window.partitionBy("source_no", "block").orderBy("order", "id", "size", *KEYS)
    ahead = F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(plan, ["source_no", "block"]).withColumn("ahead", ahead)
    extra = (F.col("ahead") + F.col("size") / 2 <= F.col("wanted")) & (F.col("wanted") > 0)
    repeats = (F.col("passes") + extra.cast("long")).cast("int")
    out = joined.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("long"), "target",
        repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), F.slice("seats", F.lit(1), repeats).alias("shards"), "order", *KEYS,
    )
    return out


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options
) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, shuffled within parts of their shard.

    Rows are told apart by id, source and text. Rows that agree in all three, null ids included, may be
    taken differently often: they are numbered in the order of all their columns, and those of the
    plan likewise, so the mix has exactly the rows of the plan. Columns stay as they are, whatever
    their names; an empty table gives no rows.
    """
    # names of our own, so that no column of the caller can clash with one of the plan
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    id_col, text_col, source_col = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    plan = stored(mix_plan(plain, id_col, text_col, source_col, seed=seed, **options).select(*KEYS, "shards"))
    repeated = plan.groupBy(*KEYS).count().where("count > 1").select(*KEYS)
    keyed = plain.withColumns(dict(zip(KEYS, row_keys(id_col, source_col, text_col), strict=True)))
    single = keyed.join(plan.where(F.size("shards") > 0).join(repeated, list(KEYS), "left_anti"), list(KEYS))
    turn = Window.partitionBy(*KEYS)
    hashed = F.xxhash64(*[c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind])
    rows = keyed.join(repeated, list(KEYS), "left_semi").withColumn("turn", F.row_number().over(turn.orderBy(hashed)))
    given = plan.join(repeated, list(KEYS), "left_semi").withColumn("turn", F.row_number().over(turn.orderBy(F.desc(F.size("shards")), "shards")))
    again = rows.join(given.where(F.size("shards") > 0), [*KEYS, "turn"])
    both = single.select(*plain.columns, "shards").unionByName(again.select(*plain.columns, "shards"))
    rows = both.select(*plain.columns, F.posexplode("shards").alias("time", "shard"))
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), "shard", "time", F.col(id_col).cast("string"), source_col))
    # a shard may be far larger than a task: it is cut by its shuffle key
    rows = rows.repartition("shard", F.pmod("at", F.lit(CUTS))).sortWithinPartitions("shard", "at")
    return rows.select(*plain.columns).toDF(*docs.columns)
