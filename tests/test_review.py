"""Batch review, states, script and drawing on small rows, against plain versions where SQL has none."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from foliolake.functions import drawing, script
from foliolake.functions import text as X
from foliolake.functions.udfs import to_gray
from foliolake.operators import batch, states


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_transliteration(spark):
    words = ["vanakkam", "naan", "aan nal", "ksha", "q", "nga", "zhi 12!", "N", "", None]
    assert column(spark, words, script.transliterate) == ["வநக்கம்", "நான்", "ஆன் நல்", "க்ஷ", "ஃ", "ங", "ழி 12!", "ண்", "", None]


def test_readings_and_demo_score(spark):
    words = ["ாமரம்!", "(கடல்)", "கடல்", "--"]
    assert column(spark, words, lambda c: script.trimmed_reading(c, X.TAMIL)) == ["மரம்", "கடல்", None, None]
    assert column(spark, words[:1], lambda c: script.trimmed_reading(c, X.TAMIL, {"ாமரம்!": "மரம்"})) == ["மரம்"]
    assert column(spark, ["ாமரம்!", "கல"], lambda c: script.plain_candidates(c, X.TAMIL)) == [["மரம்!", "ாமரம்"], []]
    lines = ["மரம், கடல்.", "12", "...", "abc கட", "கடல்#", "ாகடல்##"]
    assert column(spark, lines, lambda c: script.demo_score(c, X.TAMIL)) == [0.99, 0.3, 0.0, 0.24, 0.9, 0.76]


def test_marked_ranges():
    assert script.marked_ranges("a <mark>b</mark> c") == ("a b c", [(2, 3)])
    assert script.marked_ranges("<mark>ab</mark><mark>c</mark>d <mark>e") == ("abcd e", [(0, 3), (5, 6)])
    assert script.marked_ranges("</mark>x<mark></mark><b>") == ("</mark>x<b>", [])
    assert script.marked_ranges("க<mark>ா</mark>ல்") == ("கால்", [(0, 2)])
    assert script.marked_ranges("") == ("", [])


def test_clusters_are_never_cut():
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice(["<mark>", "</mark>", "க", "ா", "்", "b", " "]) for _ in range(12))
        text, found = script.marked_ranges(raw)
        assert text == raw.replace("</mark>", "").replace("<mark>", "") or "mark>" in text
        assert all(a < b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:]))
        assert all(b == len(text) or text[b] not in "ா்" for _, b in found) and all(a == 0 or text[a] not in "ா்" for a, _ in found)


def test_even_boxes():
    assert drawing.even_boxes(100, 50, [(10, 20), (30, 45)], 2) == [[0, 10, 50, 10], [0, 30, 50, 15]]
    assert drawing.even_boxes(100, 50, [(10, 20), (30, 50)], 4) == [[0, 10, 50, 10], [0, 20, 50, 10], [0, 30, 50, 10], [0, 40, 50, 10]]
    assert drawing.even_boxes(90, 50, [], 3) == [[0, 0, 50, 30], [0, 30, 50, 30], [0, 60, 50, 30]]


def test_content_box():
    page = np.full((100, 200), 250, np.uint8)
    page[:5], page[-3:], page[:, :10] = 10, 10, 10
    assert drawing.content_box(page) == (10, 5, 200, 97)
    assert drawing.content_box(np.zeros((100, 100), np.uint8)) == (12, 12, 88, 88)
    assert drawing.content_box(np.full((50, 40), 255, np.uint8)) == (0, 0, 40, 50)


def test_gray():
    colours = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [90, 90, 90]]], np.uint8)
    assert to_gray(colours).tolist() == [[76, 150, 29, 90]] and to_gray(colours[..., 0]).tolist() == [[255, 0, 0, 90]]


def test_attach_keeps_ties_in_order_and_caps(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, "w", None, None), (1, 1, 1, 2, "v", "p ", "T3"), (1, 1, 1, 3, "u", None, None)], "doc_id int, page int, seq int, place int, word string, pending string, tier string")
    many = [(f"c{k}", 0.5, "s") for k in range(12)] + [(" ", 0.9, "s"), (None, 0.8, "s"), ("w", 1.0, "s"), ("best", 0.7, "s"), ("none", None, "s")]
    made = spark.createDataFrame([(1, 1, 1, 1, None, many), (1, 1, 1, 2, "v", [("p", 0.9, "s"), ("q", 0.1, "s")])], "doc_id int, page int, seq int, place int, before string, candidates array<struct<text:string,score:double,source:string>>")
    got = {r.place: ([c.text for c in r.shown], r.prefill, [c.source for c in r.shown][:1]) for r in batch.attach(words, made).collect()}
    assert got == {1: (["best", *[f"c{k}" for k in range(8)]], "best", ["s"]), 2: (["p", "q"], "p ", ["llm"]), 3: ([], None, [])}


def test_retries(spark):
    rows = [(1, 1, 0.0, 429, "3"), (1, 2, 4.0, 200, None), (2, 1, 0.0, 503, None), (2, 2, 9.0, 503, "soon"), (3, 1, 0.0, 404, None), (4, 1, 1.0, None, None), (4, 2, 2.0, None, None), (4, 3, 2.0, None, None), (4, 4, 2.0, None, None), (4, 5, 2.0, None, None)]
    calls = spark.createDataFrame(rows, "call_id int, attempt int, at double, status int, retry_after string")
    got = {r.call_id: (r.attempts, r.status, r.ok, r.outage) for r in states.with_retries(calls, 12.0).collect()}
    assert got == {1: (2, 200, True, False), 2: (2, 503, False, True), 3: (1, 404, False, False), 4: (4, None, False, True)}


def test_seconds_of_engine_tags(spark):
    rows = spark.createDataFrame([("gemini", True, 1250), ("sarvam", False, 1450), ("stub", True, 9999), ("gemini", None, 10500), ("other", False, 5), ("gemini", False, None)], "e string, f boolean, ms int")
    assert [r[0] for r in rows.select(states.engine_tag(F.col("e"), F.col("f"), F.col("ms"))).collect()] == ["Gemini (fallback) · 1.3s", "Sarvam · 1.4s", "No OCR · 10.0s", "Gemini · 11s", None, "Gemini"]
