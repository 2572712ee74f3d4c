"""Line scores and text functions on inline rows, for a script with dependent signs and for Latin."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliolake.functions import text as X


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("நாளை காலை மழை பெய்யும்", 0.99),
        ("ா கல்வி சிறந்த ஒளி", 0.9),
        ("கல்வி சிறந்த � ஒளி", 0.9),
        ("12345 67", 0.3),
        ("", 0.0),
        (None, 0.0),
        ("    ", 0.0),
        ("only english words here", 0.0),
        ("கல்வி. கல்வி.", 0.9),
        ("மொழி மொழி மொழி மொழி ஒளி", 0.54),
        ("[stub] எதுவும்", 0.0),
    ],
)
def test_line_score_of_tamil(spark, text, score):
    assert one(spark, text, lambda t: X.line_score(t, X.TAMIL)) == pytest.approx(score, abs=1e-9)


def test_each_further_flaw_costs_less(spark):
    assert one(spark, "ா ா கல்வி சிறந்த ஒளி மொழி", lambda t: X.line_score(t, X.TAMIL)) == pytest.approx(0.86)


def test_orphans_know_their_columns(spark):
    assert one(spark, "ாகா ்", lambda t: X.orphan_columns(t, X.TAMIL)) == [1, 5]
    assert one(spark, "ாகா ்", lambda t: X.orphan_columns(t, X.TAMIL, with_virama=False)) == [1]


def test_words_split_at_any_white_space(spark):
    assert one(spark, "a b　c  d", X.words) == ["a", "b", "c", "d"]


def test_tokens_fold_accents_and_split_at_signs(spark):
    assert one(spark, "Café_au-LAIT 12a தமிழ்", X.tokens) == ["cafe", "au", "lait", "12a", "தம", "ழ"]


def test_routes_and_bands(spark):
    rows = spark.createDataFrame([(None,), (0.4,), (0.5,), (0.79,), (0.8,), (0.95,)], "c double").select(X.route(F.col("c")).alias("r"), X.band(F.col("c")).alias("b")).collect()
    assert [r.r for r in rows] == ["REVIEW", "REVIEW", "FLAG", "FLAG", "KEEP", "KEEP"]
    assert [r.b for r in rows[1:]] == ["doubt", "doubt", "doubt", "ok", "auto"]


def test_natural_key(spark):
    names = ["p10.png", "p9.png", "P2.png"]
    found = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n"))).collect()
    assert [r.n for r in found] == ["P2.png", "p9.png", "p10.png"]
