"""Cross-tokenizer alignment: groups of tokens that end at the same bytes, and how often their id pairs meet in a corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import stored

#: Texts tokenised at a time, and their bytes at most unless a single text is longer.
BATCH_ROWS, BATCH_BYTES = 64, 1 << 20
#: Pairs of a group that are listed before equal ones are added up, and pairs of a text held at a time.
GROUP_PAIRS, HELD_PAIRS = 1 << 16, 1 << 20
#: Bytes of pairs that a writing task holds before it writes them.
ROW_GROUP = 16 << 20
#: Token ends compared singly before slices are.
SINGLE_STEPS = 8
#: Ids whose bytes are compared with the text at a time.
CHECKED_IDS = 1 << 14
#: Id pairs sent to all tasks; the rarer ones are joined through a shuffle.
FREQUENT_PAIRS = 1 << 18


#: Characters on whose kind (letter, digit, space, other) all pattern engines agree: Latin letters, common punctuation, no separators that only some count as spaces.
PLAIN = re.compile("[\x00-\x1b\x20-\u024f\u2010-\u2027\u20ac]*")
#: How byte-level BPE cuts a text into words before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library: ids of a text, and the bytes of each id. Special tokens inside texts are plain text.

    If merges are ranked by the ids they make, texts of plain characters go through a quicker
    encoder built from the same file; all others go through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        # printable Latin-1 characters stand for themselves, the other bytes in order for 256 and up
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        named = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.pieces = [b""] * (max(named.values()) + 1)
        for name, i in named.items():
            self.pieces[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        made = [named.get("".join(m if isinstance(m, list) else m.split(" "))) for m in whole["model"]["merges"]]
        ranked = None not in made and made == sorted(made) and set(made) | set(range(256)) == set(range(256 + len(made)))
        ranks = {self.pieces[i]: i for i in range(256 + len(made))} if ranked else {}
        self.quick = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(made) else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, text: str) -> list[int]:
        if self.quick and PLAIN.fullmatch(text):
            return self.quick.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceTokenizer:
    """A sentencepiece model with byte fallback: ids of a text, to which it adds a space, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of the A and of the B tokens that end inside a group; every other token ends one.

    ``a`` and ``b`` are the byte offsets at which the tokens of either side end, rising and with
    the same last one. While the ends agree at the current shift between the two indices, a few are
    compared singly, then slices of doubling length are compared and jumped; in the slice that differs the length is halved
    down to the first difference. There the side that ends first moves on until both end
    together, which makes one irregular group and sets the new shift.
    """
    i, shift, n = 0, 0, len(a)
    inner_a: list[int] = []
    inner_b: list[int] = []
    while True:
        # one by one at first, as most runs between irregular groups are short
        j = i + shift
        for _ in range(SINGLE_STEPS):
            if a[i] != b[j]:
                break
            i += 1
            j += 1
            if i >= n:
                return inner_a, inner_b
        else:
            step = 1
            while a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                if i >= n:
                    return inner_a, inner_b
                step *= 2
            while step > 1:
                step //= 2
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
        j = i + shift
        end_a, end_b = a[i], b[j]
        while end_a != end_b:
            if end_a < end_b:
                inner_a.append(i)
                i += 1
                end_a = a[i]
            else:
                inner_b.append(j)
                j += 1
                end_b = b[j]
        i += 1
        shift = j + 1 - i
        if i == n:
            return inner_a, inner_b


def group_ends(n: int, inner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens up to and with each group, and of each group."""
    last = np.ones(n, dtype=bool)
    last[inner] = False
    ends = np.flatnonzero(last) + 1
    sizes = ends.copy()
    sizes[1:] -= ends[:-1]
    return ends, sizes


class PairLinks:
    """Distinct id pairs with their numbers of links; equal ones are added up before many are held."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray | None] = []
        self.held = 0

    def add(self, keys: np.ndarray, links: np.ndarray | None = None) -> None:
        """Pairs with one link each, or with ``links``."""
        if self.held + len(keys) > HELD_PAIRS and self.held:
            distinct, total = self.total()
            self.keys, self.links, self.held = [distinct], [total], len(distinct)
        self.keys.append(keys)
        self.links.append(links)
        self.held += len(keys)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys)
        if all(n is None for n in self.links):
            return np.unique(keys, return_counts=True)
        distinct, at = np.unique(keys, return_inverse=True)
        links = np.concatenate([np.ones(len(k), dtype=np.int64) if n is None else n for k, n in zip(self.keys, self.links, strict=True)])
        return distinct, np.bincount(at, links, len(distinct)).astype(np.int64)


def linked_pairs(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs ``a << 32 | b`` of a document that share a group, ascending, and the links of each.

    A group of m and n tokens has m * n links; equal ids of a large group are added up before they
    meet those of the other side, so a long group costs its distinct pairs only.
    """
    product = size_a * size_b
    single = product == 1
    found = PairLinks()
    found.add((a[ends_a[single] - 1] << 32) | b[ends_b[single] - 1])
    product[single] = 0
    small = np.flatnonzero((product > 0) & (product <= GROUP_PAIRS))
    # pairs of many groups at once: the k-th pair of a group takes its A token k // n and its B token k % n
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(product[small]) // HELD_PAIRS)) + 1):
        count = product[part]
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(size_b[part], count)
        at_a = np.repeat((ends_a - size_a)[part], count) + k // width
        at_b = np.repeat((ends_b - size_b)[part], count) + k % width
        found.add((a[at_a] << 32) | b[at_b])
    for g in np.flatnonzero(product > GROUP_PAIRS):
        ids_a, count_a = np.unique(a[ends_a[g] - size_a[g] : ends_a[g]], return_counts=True)
        ids_b, count_b = np.unique(b[ends_b[g] - size_b[g] : ends_b[g]], return_counts=True)
        for x, times in zip(ids_a.tolist(), count_a.tolist(), strict=True):
            found.add((x << 32) | ids_b, times * count_b)
    return found.total()


class JoinedPieces:
    """The bytes of all ids of a tokenizer behind one another."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def give(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the joined bytes of the ids are ``raw``."""
        done = 0
        for at in range(0, len(ids), CHECKED_IDS):
            part = ids[at : at + CHECKED_IDS]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            place = np.repeat(self.starts[part] - ends + sizes, sizes)
            place += np.arange(len(place))
            if self.bytes[place].tobytes() != raw[done : done + len(place)]:
                return False
            done += len(place)
        return done == len(raw)


class Aligner:
    """Both tokenizers of a worker with what is looked up per id."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.joined_a, self.joined_b = JoinedPieces(self.a.pieces), JoinedPieces(self.b.pieces)
        self.bytes_a, self.bytes_b = self.joined_a.sizes, self.joined_b.sizes
        # an id as it stands in the written groups, first inside a side and then at its end; shorter ones are filled up with zeros
        self.written_a, self.written_b = (
            np.array([f"{i}{sign}".encode() for sign in ("," + last) for i in range(len(t.pieces))], dtype="S8").view("<u8") for t, last in ((self.a, "|"), (self.b, ";"))
        )

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """``(n_a, n_b, n_groups, n_links, sha256, keys, links)`` of each text."""
        return (self._row(text) if text else NO_TOKENS for text in texts)

    def _row(self, text: str) -> tuple:
        ids_a, ids_b = self.a.encode(text), self.b.encode(text)
        raw = b" " + text.encode()
        a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
        if not self.joined_a.give(a, raw) or not self.joined_b.give(b, raw):
            return NO_TOKENS
        inner_a, inner_b = align(np.cumsum(self.bytes_a[a]).tolist(), np.cumsum(self.bytes_b[b]).tolist())
        groups = *group_ends(len(a), inner_a), *group_ends(len(b), inner_b)
        keys, links = linked_pairs(a, b, *groups)
        return len(a), len(b), len(groups[0]), int(links.sum()), self._digest(a, b, *groups), keys, links

    def _digest(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray, size_b: np.ndarray) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the groups with their ids in order."""
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[ends_a - 1] = len(self.bytes_a)
        last_b[ends_b - 1] = len(self.bytes_b)
        # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own group too
        at_a = np.arange(len(a)) + np.repeat(ends_b - size_b, size_a)
        at_b = np.arange(len(b)) + np.repeat(ends_a, size_b)
        written = np.empty(len(a) + len(b), dtype="<u8")
        written[at_a] = self.written_a[a + last_a]
        written[at_b] = self.written_b[b + last_b]
        return hashlib.sha256(written.tobytes().translate(None, b"\0")[:-1]).hexdigest()


NO_TOKENS = (0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """The worker process's aligner, kept from task to task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def bounded(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, or one row."""
    begin = total = 0
    for row, size in enumerate(sizes):
        if row > begin and (row - begin >= BATCH_ROWS or total + size > BATCH_BYTES):
            yield begin, row
            begin, total = row, 0
        total += size
    if len(sizes) > begin:
        yield begin, len(sizes)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups_sha256, pair_a, pair_b, pair_links)``, one row per input row.

    The last three columns list the document's distinct id pairs that share a group, and the
    number of links of each. A text that is null, empty, or that either tokenizer can't give back
    byte by byte with a space before it has no tokens: zeros, an empty digest and empty lists.
    """
    kind = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for whole in batches:
            for begin, end in bounded(whole.column(2).to_pylist()):
                part = whole.slice(begin, end - begin)
                n_a, n_b, groups, n_links, digests, keys, links = zip(*aligner.rows(part.column(1).to_pylist()), strict=True)
                offsets = pa.array([0, *accumulate(map(len, keys))], pa.int32())
                flat = np.concatenate(keys)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((flat >> 32, pa.int32()), (flat & 0xFFFFFFFF, pa.int32()), (np.concatenate(links), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in (n_a, n_b, groups, n_links)), pa.array(digests, pa.string()), *lists],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_a", "pair_b", "pair_links"],
                )

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"))
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair_a array<int>, pair_b array<int>, pair_links array<bigint>"
    return source.mapInArrow(encode, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: how many documents hold the id pair linked, and whether that is the most of any pair with its A id.

    Pairs are distinct within a document, so counting rows counts documents; counts are added up in
    the tasks before the shuffle. An A id has at most as many pairs as B has ids.
    """
    pairs = aligned.select(F.posexplode("pair_a").alias("at", "a"), "pair_b").select("a", F.col("pair_b")[F.col("at")].alias("b"))
    counts = stored(pairs.groupBy("a", "b").agg(F.count("*").alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per input row.

    A links to B wherever a token of either side overlaps a group, that is the tokens between two
    byte offsets at which both sides end. ``n_best`` counts the links whose id pair is the most
    frequent one of its A id in the corpus (ties included), ``count_sum`` adds up the numbers of
    documents that hold each link's id pair.

    Texts are tokenised once; the distinct pairs of each document are written to the shared
    folder. The most frequent pairs, at most ``FREQUENT_PAIRS`` by counting, meet the documents by
    broadcast, so no pair that most documents hold goes through a shuffle as a key; all others
    are joined by a shuffle. Null, empty and other texts without tokens give zeros, a null id
    stays null, repeated rows count as documents of their own, other columns are ignored and an
    empty table gives no rows. Memory is that of one text with its distinct pairs.
    """
    aligned = aligned_documents(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    aligned = stored(aligned, **{"parquet.block.size": ROW_GROUP})
    counts = stored(pair_counts(aligned))
    least = frequent_from(counts)
    held = aligned.select("row", F.posexplode("pair_a").alias("at", "a"), "pair_b", "pair_links")
    held = held.select("row", "a", F.col("pair_b")[F.col("at")].alias("b"), F.col("pair_links")[F.col("at")].alias("links"))
    frequent = counts.where(F.col("count") >= least)
    rare = counts.where(F.col("count") < least)
    # every pair is in the counts, so what the broadcast lacks is rare
    met = held.join(F.broadcast(frequent), ["a", "b"], "left")
    sums = _sums(met.where(F.col("count").isNotNull()))
    if not rare.isEmpty():
        rest = met.where(F.col("count").isNull()).select("row", "a", "b", "links")
        sums = sums.unionByName(_sums(rest.join(rare.hint("merge"), ["a", "b"])))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


def _sums(met: DataFrame) -> DataFrame:
    return met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(F.lit(0).cast("long"))).alias("n_best"),
        F.sum(F.col("links") * F.col("count")).alias("count_sum"),
    )


def frequent_from(counts: DataFrame, most: int | None = None) -> int:
    """The lowest power of two so that at most ``most`` pairs have a count that reaches it; 64 numbers reach the driver."""
    most = FREQUENT_PAIRS if most is None else most
    by_size = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("bits")).agg(F.count("*").alias("n")).collect()
    total, least = 0, 63
    for row in sorted(by_size, reverse=True):
        total += row["n"]
        if total > most:
            break
        least = row["bits"]
    return 1 << least if least < 63 else (1 << 63) - 1
