import datetime

import pytest
from pyspark.sql import functions as F

from feedlens.functions import text as T


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_match_key_ignores_case_punctuation_and_spaces(spark):
    rows = [("  Dark-Mode,  please!! ",), ("darkmode PLEASE",), (None,), ("a \tb",)]
    assert values(spark, rows, "x string", T.match_key(F.col("x"))) == ["darkmode please", "darkmode please", "", "a b"]


def test_first_words_and_query_text(spark):
    assert values(spark, [(" one two  three four five ",)], "x string", T.first_words(F.col("x"))) == ["one two three four"]
    rows = [([" dark ", "", "mode"],), ([" "],)]
    assert values(spark, rows, "x array<string>", T.query_text(F.col("x"))) == ["dark mode", None]


def test_severity_is_a_substring_test(spark):
    rows = [("tissue paper",), ("I CAN'T log in",), ("lovely",), (None,)]
    assert values(spark, rows, "x string", T.is_severe(F.col("x"))) == [True, True, False, False]


def test_parse_time(spark):
    rows = [("2024-01-05T10:00:00Z",), ("06 15, 2023",), ("not a date",), (None,)]
    got = values(spark, rows, "x string", T.parse_time(F.col("x")))
    assert got[0] is not None and got[1] == datetime.datetime(2023, 6, 15) and got[2:] == [None, None]


def test_jaccard_and_trigrams(spark):
    rows = [("dark mode now", "Dark MODE"), ("", ""), ("ab", "ab"), ("ab", "ac"), ("abcd", "abce")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(T.token_jaccard(F.col("a"), F.col("b")), T.ngram_jaccard(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [2 / 3, 1.0, 1.0, 0.0, 0.0]
    assert [r[1] for r in got][1:] == [1.0, 1.0, 0.0, 1 / 3]


def test_levels(spark):
    rows = [("High",), (" very low ",), ("7",), ("2.5",), ("nonsense",), (None,), ("NaN",)]
    assert values(spark, rows, "x string", T.level(F.col("x"), 3.0)) == [4.5, 1.0, 5.0, 2.5, 3.0, 3.0, 3.0]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_rounding_equals_python(spark, digits):
    numbers = [2.675, 0.5, 1.5, 2.5, -2.5, 4.25, 4.35, 53.025, 32.675, 0.125, 1e-9, 99.995, 7.0, -0.335, 1.00005]
    got = values(spark, [(x,) for x in numbers], "x double", T.round_half_even(F.col("x"), digits))
    assert got == [float(round(x, digits)) for x in numbers]


def test_fill_leaves_values_alone(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(T.fill("<{a}|{b}>", a=F.col("a"), b=F.col("b"))).first()[0] == "<{b}|x>"
