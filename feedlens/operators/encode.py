"""Text -> unit vector.

The built-in encoder is TF-IDF over a fixed number of hashed features. Its state (one
document count per feature) has a size which does not depend on the corpus, so it can be
broadcast safely; encoding a row needs no shuffle. Any other encoder is a function
``DataFrame -> DataFrame`` which adds a vector column, for instance an Arrow UDF around a
neural model.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.constants import NORM_TOLERANCE
from feedlens.functions import vectors as V
from feedlens.functions.text import is_blank, round_half_even, words
from feedlens.session import spread

NUM_FEATURES = 1 << 18


#: Characters on whose kind, word or not, Java and Python may differ; texts with one are cut into words by ``words``. Latin letters, dashes and quotation marks are none.
ODD = r"[\x{250}-\x{200F}\x{2028}-\x{10FFFF}]"
_OTHER = re.compile(r"\W")
#: Whether a byte may belong to a word; of two bytes that form a character, whether they may not. Three bytes form dashes and quotation marks only.
_WORD_BYTE = np.array([c >= 128 or not _OTHER.match(chr(c)) for c in range(256)])
_OTHER_PAIR = np.zeros(1 << 16, dtype=bool)
_OTHER_PAIR[[int.from_bytes(chr(c).encode()) for c in range(0x80, 0x250) if _OTHER.match(chr(c))]] = True
#: Longer words don't fit one block of md5 with its padding.
_SHORT = 55
#: Words hashed at a time.
_HASHED = 1 << 14
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def digest_heads(found: pa.Array) -> np.ndarray:
    """The number that the first 8 hex digits of the md5 of each word form; many short words go through its 64 steps at once."""
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    heads = np.empty(len(found), dtype=np.int64)
    short = np.flatnonzero(sizes <= _SHORT)
    for at in range(0, len(short), _HASHED):
        part = short[at : at + _HASHED]
        heads[part] = _short_heads(data, offsets[part], sizes[part])
    for i in np.flatnonzero(sizes > _SHORT):
        heads[i] = int.from_bytes(hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes(), usedforsecurity=False).digest()[:4])
    return heads


def _short_heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.zeros((n, 64), dtype=np.uint8)
    padded[row, column] = data[np.repeat(starts, sizes) + column]
    padded[np.arange(n), sizes] = 0x80
    padded[:, 56], padded[:, 57] = 8 * sizes & 255, 8 * sizes >> 8
    block = np.ascontiguousarray(padded.view("<u4").T)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i, sine in enumerate(_SINES):
        if i < 16:
            mixed, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        mixed = mixed + a + block[word] + np.uint32(sine)
        turn = _TURNS[i // 16][i % 4]
        a, b, c, d = d, b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn))), b, c
    return (a + np.uint32(0x67452301)).astype("<u4").view(">u4").astype(np.int64)


def spelled(text: Column) -> tuple[Column, Column]:
    """What ``features`` takes: the lower-cased text, or its words where it has ``ODD`` characters."""
    low = F.lower(text)
    return F.when(~low.rlike(ODD), low), F.when(low.rlike(ODD), words(text))


def features(plain: pa.Array, odd: pa.Array, num_features: int = NUM_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and one feature number per word, in the order of the words."""
    offsets, found = _plain_words(plain)
    number = _numbers(found)
    if odd.null_count < len(odd):
        more = V.flat(odd).fill_null([])
        more_offsets = V.list_parts(more)[0]
        more_words = more.values.slice(more.offsets[0].as_py(), more_offsets[-1])
        counts = np.diff(offsets), np.diff(more_offsets)
        row = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
        number = np.concatenate([number, _numbers(more_words.cast(pa.large_binary()))])[np.argsort(row, kind="stable")]
        offsets = offsets + more_offsets
    return offsets, number % num_features


def _plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the texts and their words. Bytes outside words are left out, and a word starts behind such a byte or where a text does."""
    texts = V.flat(texts).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_binary())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _WORD_BYTE[data]
    lead = np.flatnonzero(data >= 0xC2)
    three = lead[data[lead] >= 0xE0]
    pair = lead[_OTHER_PAIR[(data[lead].astype(np.int64) << 8) | data[lead + 1]]]
    for at in (pair, pair + 1, three, three + 1, three + 2):
        inside[at] = False
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begin = ends[:-1][ends[:-1] < ends[1:]]
    starts[begin] = inside[begin]
    kept = data[inside]
    cuts = np.append(np.flatnonzero(starts[inside]), len(kept))
    found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    return np.searchsorted(np.flatnonzero(starts), ends), found


def _numbers(found: pa.Array) -> np.ndarray:
    coded = found.dictionary_encode()
    return digest_heads(coded.dictionary)[coded.indices.to_numpy()]


@dataclass
class TextEncoder:
    """Fitted TF-IDF encoder. ``counts[f]`` is the number of texts with feature ``f``."""

    num_features: int
    n_texts: int
    counts: Broadcast

    def column(self, text: Column) -> Column:
        """The unit vector of a text; null for a blank one."""
        state, total, size = self.counts, self.n_texts, self.num_features

        def weights(plain: pa.Array, odd: pa.Array) -> pa.Array:
            offsets, feature = features(plain, odd, size)
            n = len(offsets) - 1
            cell, count = np.unique(np.repeat(np.arange(n), np.diff(offsets)) * size + feature, return_counts=True)
            row, idx = np.divmod(cell, size)
            w = count * (1.0 + np.log((1.0 + total) / (1.0 + state.value[idx])))
            length = np.sqrt(np.bincount(row, w * w, minlength=n))
            starts = np.searchsorted(row, np.arange(n + 1))
            # a text without any word has no direction, so it gets no vector
            return V.sparse_array(starts, idx, w / length[row], np.diff(starts) == 0)

        @F.arrow_udf(V.SPARSE)
        def weigh(plain: pa.Array, odd: pa.Array) -> pa.Array:
            return V.in_parts(weights, plain, odd)

        # marked so that a filter on the vector is not pushed below it and evaluated twice
        vector = weigh.asNondeterministic()
        return vector(*spelled(F.coalesce(text, F.lit(""))))

    def encode(self, df: DataFrame, text: Column | str, into: str = "vec") -> DataFrame:
        text = F.col(text) if isinstance(text, str) else text
        return spread(df).withColumn(into, self.column(text))


def fit_text_encoder(texts: DataFrame, text: Column | str, num_features: int = NUM_FEATURES) -> TextEncoder:
    """Count texts per feature. At most ``num_features`` + 1 rows leave each task and reach the driver."""
    text = F.col(text) if isinstance(text, str) else text
    present = spread(texts.where(~is_blank(text)).select(text.alias("text")))
    plain, odd = spelled(F.col("text"))

    def count(batches):
        totals = np.zeros(num_features + 1, dtype=np.int64)
        for batch in batches:
            totals[-1] += batch.num_rows  # the last cell counts texts
            for at in range(0, batch.num_rows, V.PART_ROWS):
                offsets, feature = features(*(c.slice(at, V.PART_ROWS) for c in batch.columns), num_features)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                once = np.unique(owner * num_features + feature) % num_features
                totals[:-1] += np.bincount(once, minlength=num_features)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["f", "n"])

    rows = present.select(plain.alias("plain"), odd.alias("odd")).mapInArrow(count, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(num_features + 1, dtype=np.int64)
    counts[rows.column("f").to_numpy()] = rows.column("n").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts[:-1])
    return TextEncoder(num_features, int(counts[-1]), shared)


def with_text_hash(tickets: DataFrame, model: str, text: Column) -> DataFrame:
    return tickets.withColumn("model", F.lit(model)).withColumn("text_hash", F.md5(text))


def missing_from_store(tickets: DataFrame, store: DataFrame, model: str, text: Column) -> DataFrame:
    """Distinct texts which the embedding table does not hold yet for this model."""
    hashed = with_text_hash(tickets, model, text).select("model", "text_hash", text.alias("text"))
    fresh = hashed.groupBy("model", "text_hash").agg(F.min("text").alias("text"))
    known = store.where(F.col("model") == model).select("model", "text_hash")
    return fresh.join(known, ["model", "text_hash"], "left_anti")


def extend_store(tickets: DataFrame, path: str, model: str, text: Column, encode) -> None:
    """Embed only new texts and append them to the parquet table at ``path``, by model."""
    spark = tickets.sparkSession
    if not _exists(spark, path):
        store = spark.createDataFrame([], "model string, text_hash string")
    else:
        store = spark.read.parquet(path)
    fresh = missing_from_store(tickets, store, model, text)
    encode(fresh).drop("text").write.mode("append").partitionBy("model").parquet(path)


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def with_stored_vectors(tickets: DataFrame, path: str, model: str, text: Column) -> DataFrame:
    """Attach stored vectors by content. Each text is one row of the table, so nothing multiplies."""
    store = tickets.sparkSession.read.parquet(path).where(F.col("model") == model)
    return with_text_hash(tickets, model, text).join(store, ["model", "text_hash"], "left").drop("model", "text_hash")


def norm_audit(vectors: DataFrame, vec: str = "embedding", tolerance: float = NORM_TOLERANCE) -> DataFrame:
    """How many dense vectors are not of unit length, and the range of lengths."""
    length = V.norm(F.col(vec))
    return vectors.select(length.alias("n")).agg(
        F.count("n").alias("vectors"),
        F.coalesce(F.sum((F.abs(F.col("n") - 1.0) > tolerance).cast("bigint")), F.lit(0)).alias("norm_violations"),
        round_half_even(F.min("n"), 6).alias("min_norm"),
        round_half_even(F.max("n"), 6).alias("max_norm"),
    )


def repeat_audit(first: DataFrame, second: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Compare two encodings of the same rows: rows which differ, largest difference of a weight."""
    a = first.select(key, F.col(vec).alias("a"))
    b = second.select(key, F.col(vec).alias("b"))
    both = a.join(b, key, "full")
    gap = F.lit(0.0)
    if "array" in dict(both.dtypes)["a"][:5]:
        gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y).cast("double")))
    else:
        gap = F.array_max(F.zip_with("a.w", "b.w", lambda x, y: F.abs(x - y)))
    differs = (~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")
    return both.agg(
        F.sum(differs).alias("rows_differing"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_absolute_difference")
    )
