"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import small_batches, stored

WINDOW = 2048
#: Leftover pieces packed together; each such group ends with at most a few open windows.
GROUP_PIECES = 2048
#: Bytes of each of the two generations of a worker's memory of encoded words, objects and tables included. Longer words aren't kept.
MEMORY_BYTES = 64 * 1024 * 1024
MEMORY_BYTES_OF_WORD = 48
#: What an entry takes beside the bytes of its word and ids: two objects and its place in a table.
ENTRY_BYTES = 170
#: Texts encoded at a time.
BATCH_ROWS = 128


class WordMemory(dict):
    """Ids of words as bytes, encoded when first asked for, in two generations of bounded bytes.

    When the young generation is full it becomes the old one, whose words come back as they are
    asked for again, so frequent words stay and rare ones go.
    """

    def __init__(self, encode, limit: int = MEMORY_BYTES):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= MEMORY_BYTES_OF_WORD:
            self[word] = ids
            self.held += len(word) + len(ids) + ENTRY_BYTES
            if self.held > self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 0
        return ids


class WordEncoder:
    """Token ids of whole texts, equal to the tokenizer's own, for a tokenizer that lower-cases and
    cuts words at white space and where letters meet other characters.

    A word is encoded when it is met first and remembered; a text is then the concatenation of
    its words. Texts with the start of a special token go through the tokenizer as a whole, and with
    ``whole_texts``, for tokenizers of any other kind, all do.
    """

    #: A stop or comma between a letter or digit and white space is a word of its own. The sign comes first, so that
    #: the search goes from sign to sign.
    STOP = re.compile(rb"[.,](?=[\x20\x09-\x0d]|$)(?<=[a-z0-9][.,])")
    #: Letters a-z with other signs of ASCII behind them.
    TAIL = re.compile(rb"([a-z]+)([!-/:-@[-`{-~]+)$")

    def __init__(self, path: str, end_id: int, whole_texts: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.whole_texts = whole_texts
        self.known = WordMemory(self._encode_word)
        # the printable characters that stand for the bytes of a word inside the model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        latin = (chr(c) for c in range(0x250))
        self.signs = {c: byte_level.pre_tokenize_str(c)[0][0] for c in latin if c.isalpha()}
        self.tokenize = self.tokenizer.model.tokenize

    def _encode_text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if raw.isalpha():  # a-z alone stand for themselves
            signs = word
        else:
            cut = self.TAIL.match(raw)
            if cut and not self.whole_texts:  # letters meet signs here, so both sides are words
                return self.known[cut[1]] + self.known[cut[2]]
            try:
                signs = "".join([self.signs[c] for c in word.lower()])  # such letters compose with nothing: straight to the model
            except KeyError:
                return self._encode_text(word)
        return array("I", [t.id for t in self.tokenize(signs)]).tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text with the end id behind them."""
        get = self.known.__getitem__
        for text in texts:
            words = () if self.whole_texts or "<|" in text else self.STOP.sub(rb" \g<0>", text.encode().lower()).split()
            yield (b"".join(map(get, words)) if words or not text else self._encode_text(text)) + self.end


_ENCODERS: dict[tuple[str, int, bool], WordEncoder] = {}


def encoder_of(path: str, end_id: int, whole_texts: bool) -> WordEncoder:
    """The worker process's encoder, kept from task to task."""
    key = (path, end_id, whole_texts)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


class CapacityTree:
    """Segment tree over the remaining capacities 0..window; each leaf stacks the open windows with that capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        self._bump(capacity, 1)

    def take(self, capacity: int) -> int:
        self._bump(capacity, -1)
        return self.open[capacity].pop()

    def _bump(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """Smallest capacity of at least ``need`` that has an open window, or -1."""
        node = need + self.size
        if self.count[node]:
            return need
        while node > 1:  # up to the first ancestor with something open on its right
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.size:
            node = 2 * node + (not self.count[2 * node])
        return node - self.size


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece. Pieces must come longest first and fit the window."""
    tree = CapacityTree(window)
    where, offset = [], []
    opened = 0
    for length in lengths:
        capacity = tree.tightest(length)
        if capacity < 0:
            window_id, capacity = opened, window
            opened += 1
        else:
            window_id = tree.take(capacity)
        where.append(window_id)
        offset.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, window_id)
    return where, offset


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, window: int, with_ids: bool, whole_texts: bool
) -> DataFrame:
    """One row per piece: whole windows cut from the front of a document, then what is left."""
    kind = dict(docs.dtypes)[id_col]
    ids_column = ", ids array<bigint>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, whole_texts)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(texts)):
                    tokens = len(raw) // 4
                    for begin in range(0, tokens, window):
                        piece = raw[4 * begin : 4 * (begin + window)]
                        row.append(i)
                        start.append(begin)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(tokens)
                        if with_ids:
                            ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(cut, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{ids_column}")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_ids: bool = False,
    whole_texts: bool = False,
) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``window`` tokens.

    One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, with
    ``with_ids``, the ids. Each document ends with ``end_id``. A document longer than the window
    is cut into full windows, which are sequences of their own; what is left of every document
    goes, longest first, into the open window in which it fits most tightly. The pieces that are
    left are dealt into groups of about ``GROUP_PIECES`` by a hash of document and length, and each
    group is packed by itself, so a group costs one task a few MB whatever the table's size and
    a repeated or lost task packs the same way.

    A null or empty text is a document of the end id alone. A null id is kept. Repeated rows are
    separate documents. Pieces of equal length are placed in the order of their numbers. Other columns are ignored and an empty table gives no rows. Tokens are
    computed once and written to the shared folder; with ids those are written too.
    """
    pieces = tokenised_pieces(docs, tokenizer_path, end_id, id_col, text_col, window, with_ids, whole_texts)
    # a full window is a sequence by itself, so its number can be any that no group uses: negative ones
    with small_batches(docs.sparkSession):
        pieces = stored(pieces.withColumn("_n", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == window).select(*pieces.columns, (-F.col("_n") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64(id_col, "length", "ids_crc32", "_n"), F.lit(groups)).cast("int"))
    placed = rest.select("_group", "_n", "length").groupBy("_group").applyInArrow(_pack_group(window), "_n bigint, sequence_id bigint, offset bigint")
    left = rest.drop("_group").join(placed, "_n")
    return full.unionByName(left.select(*full.columns)).drop("_n")


def _pack_group(window: int):
    def pack(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        number = table.column("_n").to_numpy()
        length = table.column("length").to_numpy()
        order = np.lexsort((number, -length))
        where, offset = best_fit_decreasing(length[order].tolist(), window)
        sequence = np.array(where, dtype=np.int64) + (np.int64(group) << np.int64(32))
        return pa.table({"_n": number[order], "sequence_id": sequence, "offset": np.array(offset, dtype=np.int64)})

    return pack
