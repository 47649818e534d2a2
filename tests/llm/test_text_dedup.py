"""Near-duplicate documents against brute force over whole shingle sets."""

import random

import pytest

from feedlens.llm import near_text


def brute(rows, width, percent):
    def sets(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        w = min(width, len(words))
        return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1))

    found = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][1], found[j][1]
            if a and b and None not in (found[i][0], found[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(found):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), low.get(root(i)) if d is not None else None) for i, (d, s) in enumerate(found)), key=repr)


def judged(spark, rows, width, percent=80):
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4, "x") for d, t in rows], "doc_id long, text string, id int, n int, a int, v int, digest string")
    out = near_text.near_duplicates(df, width=width, percent=percent).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)


def corpus(seed, big):
    rng = random.Random(seed)
    common = [f"of{i}" for i in range(12)]

    def words(n):
        return [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]

    def edited(base, share):
        return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base]

    rows = [(None, "a b c"), (1, None), (2, ""), (3, "  \t\n "), (4, "word"), (5, "WORD"), (6, "two words"), (7, "two  Words\n"), (8, "ÉTÉ été"), (9, "été ÉTÉ")]
    texts = [words(rng.choice((3, 8, 30, 80, 200, 900))) for _ in range(60)]
    for t in list(texts):
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            texts.append(edited(t, rng.choice((0, 0.01, 0.03, 0.06, 0.1))))
    base = words(120)
    texts += [edited(base, rng.choice((0.005, 0.02, 0.05))) for _ in range(big)]
    passage = words(40)
    texts += [passage + words(60) for _ in range(40)]
    texts += [words(60)[:1] * 500]
    rng.shuffle(texts)
    rows += [(100 + i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [rows[-1], (50, rows[-2][1])]


@pytest.mark.parametrize("width, seed, big", [(2, 1, 150), (5, 2, 20)])
def test_components_equal_brute_force(spark, width, seed, big):
    rows = corpus(seed, big)
    assert judged(spark, rows, width) == brute(rows, width, 80)


def test_small_blocks_and_lists_change_nothing(spark, monkeypatch):
    rows = corpus(3, 60)
    for name, value in (("HOT", 3), ("LEFT_ROWS", 4), ("RIGHT_ROWS", 4), ("MEMBERS", 2), ("BROADCAST_IDS", 0), ("PIVOT_VALUES", 4)):
        monkeypatch.setattr(near_text, name, value)
    assert judged(spark, rows, 2) == brute(rows, 2, 80)


def test_empty_table(spark):
    assert judged(spark, [], 2) == []


def test_least_shared_bounds_the_binomial_tail():
    assert near_text.least_shared(64, 100) == 64
    assert 30 < near_text.least_shared(64, 80) < 45
