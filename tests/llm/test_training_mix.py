"""Language identification, mixing, packing and the pipeline."""

import importlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from feedlens.llm import language, mixing, packing

# ---- language ----

WORDS = {
    "aa": "the of and with this that from have been were their which there would about into after before under".split(),
    "bb": "der die und nicht mit eine werden über zwischen schon können auch einem wieder gegen unter durch".split(),
    "cc": "el los con para una por como pero más entre cuando también sobre ser tiene hasta desde donde".split(),
}


def sentences(lang, n, rng):
    stems = WORDS[lang]
    return " ".join(rng.choice(stems) + (rng.choice(stems)[:3] if rng.random() < 0.3 else "") for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(sentences(lang, 60, rng), lang) for lang in WORDS for _ in range(60)] + [(None, "aa"), ("text", None), ("123", "dd")]
    return language.fit_languages(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_of_unseen_texts(spark, model):
    assert model.languages == ("aa", "bb", "cc") and len({len(d) for d in model.dictionaries}) == 1
    rng = random.Random(2)
    rows = [(lang, sentences(lang, n, rng)) for lang in WORDS for n in (12, 40, 3000) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "zz", 0.5, True) for i, (_, t) in enumerate(rows)], "doc_id long, text string, lang string, score double, rejected boolean")
    out = {r["doc_id"]: r for r in language.identify_languages(df, model).collect()}
    assert sum(out[i]["lang_pred"] == lang for i, (lang, _) in enumerate(rows)) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_texts_without_letters_and_ties(spark, model):
    texts = [None, "", " \n", "123 !?", "é", "x" * 100_000, "日本語"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "the of and"), (0, None)], "doc_id long, text string")
    out = language.identify_languages(df, model).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        empty = r["doc_id"] is not None and r["doc_id"] < 4
        assert (r["lang_pred"] == "und") == empty and (not empty or r["rejected"])
    assert language.identify_languages(df.limit(0), model).collect() == []
    twins = language.LanguageModel(("aa", "bb"), (model.dictionaries[0],) * 2)
    tied = language.identify_languages(df.where("doc_id is null"), twins).first()
    assert (tied["lang_pred"], tied["score"], tied["rejected"]) == ("aa", 0.5, True)
    nothing = language.identify_languages(df, language.LanguageModel((), ())).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


@pytest.mark.parametrize("rare", ["kurz", "qua vadis nunc domine"])
def test_a_language_of_one_short_row_leaves_the_others_whole(spark, model, rare):
    rng = random.Random(1)
    rows = [(sentences(lang, 60, rng), lang) for lang in WORDS for _ in range(60)] + [(rare, "zz")]
    found = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert found.languages == (*model.languages, "zz") and found.dictionaries[:3] == model.dictionaries
    assert len({len(d) for d in found.dictionaries}) == 1
    df = spark.createDataFrame([(lang, sentences(lang, 40, rng)) for lang in WORDS for _ in range(30)], "doc_id string, text string")
    out = language.identify_languages(df, found).collect()
    assert sum(r["doc_id"] == r["lang_pred"] and not r["rejected"] for r in out) >= 0.98 * len(out)


@pytest.mark.parametrize("copied", range(4))
def test_copies_take_no_place_of_other_texts(spark, copied):
    rng = random.Random(4)
    rows = [(sentences(lang, 60, rng), lang) for lang in WORDS for _ in range(60)]
    once = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), rows=40)
    # half of all rows of a language are one text, or nearly all are; the others have the places of the sample that they had
    copies = [rows[copied]] * (60 if copied % 2 else 6000)
    assert language.fit_languages(spark.createDataFrame(rows + copies, "text string, lang string"), rows=40) == once
    assert len(set(once.dictionaries[0].split())) > 20


def test_places_of_the_sample_cover_whole_texts(spark):
    # all texts of a language begin alike, so their beginnings teach nothing
    rng = random.Random(6)
    rows = [("same words first " * 60 + sentences(lang, 400, rng), lang) for lang in WORDS for _ in range(60)]
    found = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), rows=60, size=6000)
    df = spark.createDataFrame([(lang, sentences(lang, 40, rng)) for lang in WORDS for _ in range(20)], "doc_id string, text string")
    out = language.identify_languages(df, found).collect()
    assert sum(r["doc_id"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    with pytest.raises(ValueError):
        language.identify_languages(df.withColumnRenamed("doc_id", "Score"), found, id_col="Score")


# ---- mixing ----


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def mixed_rows(n=3000, seed=1):
    rng = random.Random(seed)
    names = ["hot"] * 12 + ["b", "é", "z", "tiny", None, "A"]
    rows = [(i, " ".join(["w"] * (rng.choice((0, 1, 5, 40, 60)) if s != "tiny" else 1)), s) for i, s in ((i, rng.choice(names)) for i in range(n))]
    return rows + [(n, None, "b"), (n + 1, " \t\n", "empty"), (None, "a b c", "b"), (5, "again five", "b"), (5, "again five", "b")]


@pytest.fixture(scope="module")
def plan(spark):
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in mixed_rows()], "doc_id long, text string, source string, size int, block int, target int").repartition(3)
    return df, mixing.mix_plan(df).collect()


def test_targets_and_taken_words(plan):
    _, out = plan
    rows = mixed_rows()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"] and len(r["shards"]) == r["repeats"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(spark, plan):
    df, out = plan
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_mix_repeats_rows_and_keeps_columns(plan):
    df, out = plan
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    want = Counter()
    for r in out:
        want[r["doc_id"]] += r["repeats"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_rows_equal_in_id_source_and_text_are_mixed_as_planned(spark):
    rng = random.Random(8)
    rows = [(None, "one two three", "hot", 1) for _ in range(250)] + [(None, f"a b c{i % 9}", "hot", 2) for i in range(150)]
    rows += [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("xyz"), 3) for i in range(300)] + [(7, "again", "x", 4)] * 40
    names = "doc_id long, text string, source string, _size int, shards int, turn int, key_0 int, _shards int"
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], names).repartition(5)
    plan = mixing.mix_plan(df).collect()
    want = Counter()
    for r in plan:
        want[(r["doc_id"], r["source"], r["size"])] += r["repeats"]
    got = mixing.mix_documents(df).collect()
    assert len(got) == sum(want.values()) and got[0].__fields__ == df.columns
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got) == +want
    other = mixing.mix_documents(df.repartition(2)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, other))


def test_quotas_are_exact_and_shards_even(spark):
    draws = {1: 1000, 2: 0, 3: 1, 4: 333, 5: 77}
    q = mixing.shard_quotas(spark.createDataFrame(list(draws.items()), "source_no int, n long"), 8, 3).collect()
    upto = {r["source_no"]: r["upto"] for r in q}
    assert {s: u[-1] for s, u in upto.items()} == draws
    per = np.array([np.diff([0, *u]) for u in upto.values()])
    assert (per >= 0).all() and np.ptp(per.sum(axis=0)) <= 3
    one = np.diff([0, *upto[1]])  # drawn, not simply an eighth each
    assert abs(one - 125).max() < 40 and np.ptp(one) > 0


def test_hypergeometric_draws_follow_their_distribution(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    k = mixing._hypergeometric(F.lit(50), F.lit(20), F.lit(10), F.col("u"))
    got = {r["k"]: r["count"] / 20_000 for r in df.select(k.alias("k")).groupBy("k").count().collect()}
    from math import comb

    for i in range(11):
        assert got.get(i, 0) == pytest.approx(comb(20, i) * comb(30, 10 - i) / comb(50, 10), abs=2e-4)


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(df).collect() == [] and mixing.mix_documents(df).collect() == []
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], df.schema)
    assert [(r["taken"], r["target"]) for r in mixing.mix_plan(empty).collect()] == [(0, 0.0), (0, 0.0)]


# ---- packing ----

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's don't I'LL", "", None, "  \n", "Σ ΑΣ. x", "a <|endoftext|> b<|endoftext|>", "é ́a 日本語", "end. of, this.\nÉt, ÀÉ 3.14, x.. y.", "x" * 3000, "a\x1db c"]


def packed(spark, texts, **options):
    rows = [(i, t, 7, 7, 7) for i, t in enumerate(texts)] + [(None, "null id", 7, 7, 7), (0, texts[0], 7, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, length int, sequence_id int")
    return rows, packing.pack_documents(df.repartition(3), PATH, with_ids=True, **options).collect()


@pytest.mark.parametrize("group", [16384, 20])
def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ODD + [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.choice((5, 50, 300, 900, 3000)))) for _ in range(150)]
    rows, out = packed(spark, texts)
    got = Counter()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got[(r["doc_id"], r["start"])] += 1
        by_doc.setdefault(r["doc_id"], {})[r["start"]] = r
    for doc, text, *_ in rows:
        want = own.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = [by_doc[doc][s] for s in sorted(by_doc[doc])]
        assert [i for p in pieces for i in p["ids"]] == want and all(p["doc_tokens"] == len(want) for p in pieces)
    assert all(got[k] == (2 if k[0] == 0 else 1) for k in got)
    for pieces in by_sequence.values():
        ends = 0
        for at, length in sorted(pieces):
            assert at == ends
            ends += length
        assert ends <= 2048
    tokens = sum(r["length"] for r in out)
    assert group == 20 or len(by_sequence) <= tokens / 2048 * 1.03 + 2


def test_word_memory_is_bounded_and_changes_nothing():
    asked = []

    def encode(word):
        asked.append(word)
        return word[::-1]

    memory = packing.WordMemory(encode, limit=20 * (packing.ENTRY_BYTES + 12))
    rng = random.Random(2)
    for _ in range(5000):
        word = b"often" if rng.random() < 0.5 else b"%06d" % rng.randrange(500)
        assert memory[word] == word[::-1] and len(memory) <= 20 and len(memory.old) <= 21
    assert asked.count(b"often") == 1 and len(asked) > 500
    long = b"x" * (packing.MEMORY_BYTES_OF_WORD + 1)
    assert memory[long] == long and long not in memory


def test_words_with_signs_behind_are_cut_and_remembered(monkeypatch):
    texts = ["ended,### once***! plain ended,###", "ended*** 'tis it's don'' ended's,", "\u00c8tre \u0130ki r\u00e9\u00e7u,### \u4e00x, a1,## x<|", "ab\u0301c,, x\u00e9\u00e9 \u01f0\u0323"]
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(path, 1)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode(texts)] == want
    whole = []
    monkeypatch.setattr(encoder, "_encode_text", lambda text: whole.append(text) or b"")
    list(encoder.encode(["fresh,### fresh*** \u00e9t\u00e9fresh"]))
    assert not any("fresh" in text for text in whole)  # only the signs go through the whole tokenizer


def test_tightest_window_equals_a_plain_search():
    rng = random.Random(5)
    lengths = sorted((rng.randrange(1, 64) for _ in range(400)), reverse=True)
    where, offset = packing.best_fit_decreasing(lengths, 64)
    open_, want = [], []
    for n in lengths:
        fits = [(c, -i) for i, c in enumerate(open_) if c >= n]
        capacity = min(fits)[0] if fits else 64
        if not fits:
            open_.append(64)
        want.append(64 - capacity)
        i = next(j for j, c in enumerate(open_) if c == capacity and (fits or j == len(open_) - 1))
        open_[i] -= n
    assert offset == want and max(where) + 1 == len(open_)


def test_whole_texts_and_empty_table(spark):
    _, a = packed(spark, ODD)
    _, b = packed(spark, ODD, whole_texts=True)
    assert sorted((repr(r["doc_id"]), r["start"], r["ids"]) for r in a) == sorted((repr(r["doc_id"]), r["start"], r["ids"]) for r in b)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).collect() == []


# ---- pipeline ----


def test_stages_take_effect_one_after_the_other(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(9)
    rows = [(i, sentences(lang, 120, rng), lang, f"s{i % 4}", 1, "x") for i, lang in enumerate(list(WORDS) * 40)]
    copies = [(200 + i, rows[i][1] + " more", rows[i][2], "s0", 1, "x") for i in range(10)]
    odd = [(300, None, None, None, None, "x"), (301, "12 34", "aa", "s1", 1, "x"), (302, rows[50][1], None, None, 1, "x"), rows[3], (None, "the of and with this that", "aa", "s1", 1, "x")]
    docs = spark.createDataFrame(rows + copies + odd, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(3)
    by_name = dict(pipeline.STAGES)
    assert list(by_name) == ["language", "near_dedup", "mixing", "packing"]
    one = by_name["language"](spark, docs, "")
    assert one.columns == docs.columns and {300, 301}.isdisjoint({r["doc_id"] for r in one.collect()})
    two = by_name["near_dedup"](spark, one, "")
    ids = [r["doc_id"] for r in two.collect()]
    assert two.columns == docs.columns and sorted(ids, key=repr) == sorted([*range(120), None], key=repr)
    three = by_name["mixing"](spark, two, "")
    assert three.columns == docs.columns and set(Counter(r["doc_id"] for r in three.collect())) <= set(ids)
    four = by_name["packing"](spark, three, "").collect()
    assert Counter(r["doc_id"] for r in four if r["start"] == 0) == Counter(r["doc_id"] for r in three.collect())
    for stage in by_name.values():
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_keep_columns_named_like_their_own(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(9)
    extra = ["score", "rejected", "margin", "lang_pred", "_size", "_0", "_1", "_2", "_shard", "_time", "_key", "_shards", "_c0", "n", "length", "sequence_id"]
    rows = [(i, sentences(lang, 120, rng), lang, f"s{i % 4}", 1, *range(len(extra))) for i, lang in enumerate(list(WORDS) * 20)]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, plain + "".join(f", {c} int" for c in extra)).repartition(3)
    bare = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        found, alone = stage(spark, docs, ""), stage(spark, bare, "")
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert len(rows) and all(list(r[5:]) == list(range(len(extra))) for r in rows)
        assert sorted(tuple(r[:5]) for r in rows) == sorted(map(tuple, alone.collect()))
    assert pipeline.STAGES[-1][1](spark, docs, "").count() == pipeline.STAGES[-1][1](spark, bare, "").count()
