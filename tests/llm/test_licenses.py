"""License scan against plain matching, and the evaluation of tagged expressions."""

import random
import re

import pytest

from feedlens.llm import licenses, registry

BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
UPPER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def slow_places(words, phrases):
    return [(i, label) for i in range(len(words)) for phrase, label in phrases.items() if tuple(words[i : i + len(phrase)]) == phrase]


def slow_digest(text):
    words = slow_words(text)
    base = slow_places(words, BASE)
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in base}))


def slow_labels(text):
    """Labels of names and notice texts by a plain search, without tags."""
    words = slow_words(text)
    names = {tuple(p.split()): label for label, each in licenses.NAMES.items() for p in each}
    texts = {tuple(p.split()): label for label, each in licenses.TEXTS.items() for p in each}
    spans = [(i, i + len(p), label) for p, label in names.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    own = {s[2] for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)}
    return {label for _, label in slow_places(words, BASE)} | own | {label for _, label in slow_places(words, texts)}


def frame(spark, texts):
    rows = [(i, t, "x", 1, "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_words int, matches string, score double")


def digest(spark, texts):
    found = licenses.license_digest(licenses.scan_licenses(frame(spark, texts)))
    return {r["doc_id"]: r for r in found.collect()}


def test_whole_query_equals_plain_matching(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op11_license_scan(spark, SF).collect()
    assert len(rows) == len(docs) and any(r["n_base"] for r in rows)
    for r in rows:
        text = docs[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_digest(text)
        assert set(filter(None, r["labels"].split(","))) == slow_labels(text)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_random_texts_equal_plain_matching(spark):
    rng = random.Random(3)
    pieces = ["MIT", "License", "apache", "general", "Public", "license", "gnu", "lesser", "cc", "by", "nc", "sa", "x1", "ÄÖ", "É", "mit license", "all rights reserved"]
    gaps = [" ", "\n", "-", ", ", "\t\t", "\x0b", "\x00", "_", "__ ", "'", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "mit", "license", "mit license mit license", "MIT License", "MIT-License_mit/license", "mit license " * 5000, "ümit license", "mit licenses"]
    out = digest(spark, texts)
    for i, text in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_digest(text), text
        assert set(filter(None, r["labels"].split(","))) == slow_labels(text), text
    empty = out[texts.index(None)]
    assert (empty["labels"], empty["score"], empty["obligation"], empty["n_expressions"]) == ("", 0.0, None, 0)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license"), (1, None)], "doc_id long, text string")
    out = licenses.license_digest(licenses.scan_licenses(df)).collect()
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in out) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert licenses.license_digest(licenses.scan_licenses(df.limit(0))).collect() == []


@pytest.mark.parametrize("text, postfix, valid, level, choice, labels", [
    ("MIT", "mit", True, 0, ["mit"], ["mit"]),
    ("MIT OR GPL-3.0-only AND Zlib", "mit gpl-3.0-only zlib and or", True, 0, ["mit"], ["gpl", "mit", "zlib"]),
    ("(MIT OR GPL-2.0+) AND MPL-2.0", "mit gpl-2.0+ or mpl-2.0 and", True, 1, ["mit", "mpl"], ["gpl", "mit", "mpl"]),
    ("GPL-2.0-only WITH Classpath-exception-2.0 */", "gpl-2.0-only classpath-exception-2.0 with", True, 1, ["gpl"], ["gpl"]),
    ("GPL-2.0 with x AND BSD-3-Clause or Foo", "gpl-2.0 x with bsd-3-clause and foo or", True, 1, ["bsd", "gpl"], ["bsd", "foo", "gpl"]),
    ("Apache-2.0 and", "apache-2.0", True, 0, ["apache"], ["apache"]),
    ("Apache-2.0 is what we use", "apache-2.0", True, 0, ["apache"], ["apache"]),
    ("((MIT OR ISC", "mit isc or", False, 0, ["mit"], ["isc", "mit"]),
    ("MIT) OR GPL-3.0", "mit", True, 0, ["mit"], ["mit"]),
    ("CC-BY-NC-SA-4.0.", "cc-by-nc-sa-4.0", True, 3, ["cc-by-nc-sa"], ["cc-by-nc-sa"]),
])
def test_expressions(text, postfix, valid, level, choice, labels):
    n, matches, expressions = licenses.LicenseScanner().scan(f"// SPDX-License-Identifier: {text}\nMIT".encode())
    assert expressions == [(0, postfix, valid, level, choice, labels)]
    assert [(m[0], m[1], m[4]) for m in matches if m[0] == "tag"] == [("tag", label, 1.0 if valid else 0.6) for label in labels]


def slow_value(tokens):
    """Obligation by recursive descent over a well-formed expression."""
    def either():
        level = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            level = min(level, both())
        return level

    def both():
        level = exempt()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            level = max(level, exempt())
        return level

    def exempt():
        if tokens[0] == "(":
            tokens.pop(0)
            level = either()
            tokens.pop(0)
        else:
            level = licenses.FAMILIES.get(licenses.family(tokens.pop(0)), licenses.UNKNOWN)
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            tokens.pop(0)
            level = licenses.WEAK if level == licenses.STRONG else level
        return level

    return either()


def test_random_expressions_equal_recursive_descent():
    rng = random.Random(8)

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["mit", "gpl-3.0-only", "mpl-2.0", "cc-by-nc-4.0", "foo", "lgpl-2.1+", "apache-2.0"])
            return [name] + (["with", "classpath-exception-2.0"] if rng.random() < 0.2 else [])
        inner = build(depth - 1) + [rng.choice(["and", "or"])] + build(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(500):
        tokens = build(5)
        assert licenses.expression_tokens(" ".join(tokens).encode()) == tokens
        postfix, valid = licenses.shunting_yard(tokens)
        assert valid and licenses.evaluate(postfix)[0] == slow_value(list(tokens))


def test_other_forms_of_a_tag_and_empty_tags():
    scan = licenses.LicenseScanner().scan
    assert scan(b"spdx license identifier mit")[2] == []
    n, matches, expressions = scan(b"SPDX-License-Identifier:\nMIT")
    assert expressions == [] and matches == [("tag", "", 0, 3, 0.0)]
    assert scan(b"x License-Expression: ISC and MIT")[2] == [(1, "isc mit and", True, 0, ["isc", "mit"], ["isc", "mit"])]
    many = b"SPDX-License-Identifier: MIT " * 20000
    assert len(scan(many)[2]) == 20000


def test_declared_names_are_surer_than_mentions():
    scan = licenses.LicenseScanner().scan
    assert [(m[1], m[4]) for m in scan(b"Licensed under CC BY-NC 4.0.")[1]] == [("cc-by-nc", licenses.DECLARED)]
    assert [(m[1], m[4]) for m in scan(b"we spoke about cc by sa")[1]] == [("cc-by-sa", licenses.MENTION)]
