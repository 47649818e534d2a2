"""Cross-tokenizer alignment against plain loops over bytes and occurrence pairs."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from feedlens.llm import alignment, registry

PATHS = [public_tokenizers.path(p) for p in registry.ALIGNED]
SF = "/root/testdata/sf0.001"


@cache
def models():
    a_model = Tokenizer.from_file(PATHS[0])
    a_model.encode_special_tokens = True
    return a_model, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), {v: k for k, v in byte_signs().items()}


def slow_tokens(text):
    """Ids and byte ends of either side, or None where a side doesn't give the text back."""
    if not text:
        return None
    raw = b" " + text.encode()
    a_model, b_model, decoder = models()
    a = a_model.encode(" " + text, add_special_tokens=False).ids
    b = b_model.encode(text)
    bytes_a = [bytes(decoder[c] for c in a_model.id_to_token(i)) for i in a]
    bytes_b = []
    for i in b:
        piece = b_model.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and b_model.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    return a, np.cumsum([len(x) for x in bytes_a]).tolist(), b, np.cumsum([len(x) for x in bytes_b]).tolist()


def byte_signs():
    """Byte to its printable character, as the decoder of the library reads them back."""
    decoder = ByteLevel()
    shown = {}
    for c in (chr(i) for i in range(0x21, 0x144)):
        back = decoder.decode([c])
        if len(back) == 1 and back != "�" and ord(back) < 128:
            shown[ord(back)] = c
    high = [b for b in range(128, 256)]
    rest = [c for c in (chr(i) for i in range(0xA1, 0x144)) if c not in shown.values() and c != "\xad"]
    direct = {b: chr(b) for b in high if 161 <= b <= 172 or 174 <= b}
    shown.update(direct)
    left = [c for c in rest if c not in direct.values()]
    shown.update(zip([b for b in high if b not in direct], left, strict=False))
    return shown


def slow_groups(ends_a, ends_b):
    """Group of each token, by the common ends at or behind it."""
    common = sorted(set(ends_a) & set(ends_b))
    number = {}
    for ends in (ends_a, ends_b):
        for e in ends:
            number[e] = sum(c < e for c in common)
    return [number[e] for e in ends_a], [number[e] for e in ends_b]


def slow_result(texts, tokens=slow_tokens):
    """The whole query's columns per text, from all occurrence pairs."""
    rows, held = [], Counter()
    for text in texts:
        found = tokens(text)
        if found is None:
            rows.append(None)
            continue
        a, ends_a, b, ends_b = found
        of_a, of_b = slow_groups(ends_a, ends_b)
        groups = defaultdict(lambda: ([], []))
        for side, ids, of in ((0, a, of_a), (1, b, of_b)):
            for i, g in zip(ids, of, strict=True):
                groups[g][side].append(i)
        links = [(x, y) for left, right in groups.values() for x in left for y in right]
        held.update(set(links))
        written = ";".join(",".join(map(str, groups[g][0])) + "|" + ",".join(map(str, groups[g][1])) for g in sorted(groups))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == best[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  two  spaces ", "tab\tnew\nline\r\n", "<|endoftext|> and <s></s><unk>", "▁ underline", "naïve café über Straße", "日本語のテキスト", "🙂🙃 emoji 👩‍👩‍👧",
    "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00zero\x01", "ﬁ ligature ① ＡＢＣ", "é combining", "x" * 300, "internationalization " * 40, "the the the", "мир труд май", "​zero width﻿", "0x1F 3.14159 1,000,000",
]


def test_whole_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    short = [r for r in docs if len(r["text"] or "") < 4000]
    texts = [r["text"] for r in short]
    df = spark.createDataFrame([(r["doc_id"], r["text"], "x", 1, 2, 3, 4) for r in short], "doc_id long, text string, row string, a int, b int, count int, links int")
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(df, *PATHS).collect()}
    assert [out[r["doc_id"]] for r in short] == slow_result(texts)
    rows = registry.op13_token_alignment(spark, SF).collect()
    assert len(rows) == len(docs) and sum(r["n_a"] > 0 for r in rows) > 0.9 * len(docs)
    long = {r["doc_id"]: r for r in rows}
    for r in docs:
        if len(r["text"] or "") >= 4000:
            a, ends_a, b, ends_b = slow_tokens(r["text"])
            assert (long[r["doc_id"]]["n_a"], long[r["doc_id"]]["n_b"], long[r["doc_id"]]["n_groups"]) == (len(a), len(b), len(set(ends_a) & set(ends_b)))


@pytest.mark.parametrize("frequent", [1 << 18, 3, 0])
def test_odd_texts_and_rare_pairs_through_the_shuffle(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT_PAIRS", frequent)
    texts = ODD + ODD[7:12] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string").repartition(3)
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(df, *PATHS).collect()}
    assert [out[i] for i in range(len(texts))] == slow_result(texts)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (1, None)], "doc_id long, text string")
    out = alignment.align_tokenizers(df, *PATHS).collect()
    full = slow_result(["one two"] * 3)[0]
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in out) == sorted([("None", *full), ("1", *full), ("1", *full), ("1", 0, 0, 0, 0, 0, 0, "")])
    assert alignment.align_tokenizers(df.limit(0), *PATHS).collect() == []


def test_plain_texts_get_the_ids_of_the_library():
    """Every plain character beside letters, digits, spaces and signs, and odd texts."""
    a_model, b_model, _ = models()
    side = alignment.ByteTokenizer(PATHS[0])
    assert side.quick
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if alignment.PLAIN.fullmatch(chr(c))]
    rng = random.Random(9)
    texts = ["".join(f"{c}{rng.choice(['a', ' ', '1', '!', chr(39) + 's', chr(10)])}{c}{c} {c}" for c in plain[i : i + 8]) for i in range(0, len(plain), 8)]
    texts += ["".join(rng.choice([*plain, " ", " ", "the", "\n", "'ll", "  ", "12"]) for _ in range(60)) for _ in range(600)] + [t for t in ODD if t]
    assert [side.encode(t) for t in texts] == [a_model.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_runs_and_irregular_groups_equal_common_ends():
    rng = random.Random(6)
    for _ in range(400):
        n = rng.choice([1, 2, 5, 40, 300])
        last = 3 * n + 1
        keep = rng.choice([0.05, 0.5, 0.95, 1.0])
        base = sorted(rng.sample(range(1, last), n))
        a = [x for x in base if rng.random() < keep] + [last]
        b = [x for x in base if rng.random() < keep] + [last]
        ends_a, ends_b = (alignment.group_ends(len(x), inner)[0] for x, inner in zip((a, b), alignment.align(a, b), strict=True))
        common = sorted(set(a) & set(b))
        assert [a[i - 1] for i in ends_a] == common and [b[j - 1] for j in ends_b] == common


@pytest.mark.parametrize("limit", [1 << 16, 6, 0])
def test_pairs_of_groups_equal_all_occurrence_pairs(monkeypatch, limit):
    monkeypatch.setattr(alignment, "GROUP_PAIRS", limit if limit else 1)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 4 * limit if limit else 3)
    rng = random.Random(7)
    for _ in range(100):
        sizes = [(rng.randrange(1, 6), rng.randrange(1, 6)) if rng.random() < 0.4 else (1, 1) for _ in range(rng.randrange(1, 60))]
        groups = [([rng.randrange(4) for _ in range(m)], [rng.randrange(4) for _ in range(n)]) for m, n in sizes]
        a, b = (np.array([x for g in groups for x in g[s]]) for s in (0, 1))
        size_a, size_b = (np.array([len(g[s]) for g in groups]) for s in (0, 1))
        keys, links = alignment.linked_pairs(a, b, np.cumsum(size_a), size_a, np.cumsum(size_b), size_b)
        want = Counter((x << 32) | y for left, right in groups for x in left for y in right)
        assert dict(zip(keys.tolist(), links.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()


def test_a_long_irregular_group_costs_its_distinct_pairs():
    a, b = np.arange(50_000) % 3, np.arange(40_000) % 2
    whole_a, whole_b = np.array([50_000]), np.array([40_000])
    keys, links = alignment.linked_pairs(a, b, whole_a, whole_a, whole_b, whole_b)
    assert len(keys) == 6 and links.sum() == 50_000 * 40_000


def test_bytes_of_ids_are_compared_slice_by_slice(monkeypatch):
    pieces = [b"", b"a", b"bc", b"\xc3", b"\xa9d", b" "]
    joined = alignment.JoinedPieces(pieces)
    rng = random.Random(4)
    for size in (1, 3, 1 << 14):
        monkeypatch.setattr(alignment, "CHECKED_IDS", size)
        for _ in range(50):
            ids = [rng.randrange(6) for _ in range(rng.randrange(12))]
            raw = b"".join(pieces[i] for i in ids)
            assert joined.give(np.array(ids, dtype=np.int64), raw)
            assert not joined.give(np.array(ids, dtype=np.int64), raw + b"x")
            if raw:
                assert not joined.give(np.array(ids, dtype=np.int64), raw[:-1]) and not joined.give(np.array(ids, dtype=np.int64), b"?" + raw[1:])


@pytest.mark.parametrize("single", [1, 2, 8, 50])
def test_alignment_is_the_same_however_many_ends_are_compared_singly(monkeypatch, single):
    monkeypatch.setattr(alignment, "SINGLE_STEPS", single)
    rng = random.Random(single)
    for _ in range(300):
        last = rng.randrange(1, 120)
        both = [x for x in range(1, last) if rng.random() < 0.8]
        a, b = (sorted({x for x in both if rng.random() < 0.95} | {last}) for _ in range(2))
        ends = set(a) & set(b)
        assert alignment.align(a, b) == tuple([i for i, x in enumerate(side) if x not in ends] for side in (a, b))
