"""Operators on inline rows: overlay, dictionary, jobs, layout, export, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import text as X
from foliolake.functions.udfs import edit_operations, snippet_of
from foliolake.operators import dictionary, export, filtering, jobs, layout, overlay, pages, review, search

LINE = "நாளை காலை மழை பெயயும்"


def lines(spark, *bodies):
    return spark.createDataFrame([(1, 1, i + 1, b) for i, b in enumerate(bodies)], "doc_id long, page int, seq int, body string")


def saved(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id long, page int, seq int, word int, pos int, before string, after string")


def finals(spark, bodies, *rows):
    return [r.final_body for r in overlay.apply(lines(spark, *bodies), saved(spark, *rows)).orderBy("seq").collect()]


def test_overlay_applies_and_guards(spark):
    assert finals(spark, [LINE], (1, 4, 1, "பெயயும்", "பெய்யும்")) == [LINE.replace("பெயயும்", "பெய்யும்")]
    assert finals(spark, ["a  b"], (1, 2, 1, "stale", "c")) == ["a  b"]
    assert finals(spark, ["a  b"], (1, 2, 1, None, "c")) == ["a c"]
    assert finals(spark, ["a b"], (1, 3, 1, "b", "c"), (1, 0, 1, None, "c")) == ["a b"]
    assert finals(spark, ["a b"], (1, 1, 1, "a", "x"), (1, 1, 2, "a", "y")) == ["y b"]


def test_learned_pairs_are_new_ones(spark):
    new = saved(spark, (1, 1, 1, "a", "b"), (1, 2, 1, "c", "c"), (2, 1, 1, "d", "e"))
    assert [tuple(r) for r in overlay.learned(new, saved(spark, (9, 9, 1, "d", "e"))).orderBy("before").collect()] == [("a", "b"), ("c", "c")]


def test_dictionary_counts_each_event_once(spark):
    rows = [(1, 1, "accept", "a", "b"), (2, 2, "accept", "a", "c"), (2, 2, "accept", "a", "c"), (3, 3, "skip", "a", "x"), (4, 4, "skip", "z", "y")]
    log = spark.createDataFrame(rows, "event_id long, ts int, kind string, before string, after string")
    found = {r.before: tuple(r)[1:4] for r in dictionary.fold(log).collect()}
    assert found == {"a": ("c", 2, 1), "z": ("y", 0, 1)}
    assert [r.before for r in dictionary.gated(dictionary.fold(log)).collect()] == ["a"]


def test_newest_invalid_result_hides_older_ones(spark):
    rows = [("1", "s", "auto", "done", 1, True), ("2", "s", "auto", "done", 2, False), ("3", "t", "auto", "done", 1, True)]
    table = spark.createDataFrame(rows, "job_id string, sha256 string, mode string, status string, created_at int, usable boolean")
    assert [r.job_id for r in jobs.latest_done(table).collect()] == ["3"]


def test_broken_results_have_no_pages(spark):
    table = spark.createDataFrame([("{broken",), (None,), ('{"pages": [{"page": 1, "lines": [{"id": "L1", "seq": 1, "body": "x", "confidence": 0.7}]}]}',)], "result_json string")
    assert sorted(r.n for r in pages.parse_results(table).select(F.size("pages").alias("n")).collect()) == [0, 0, 1]


def test_old_lines_are_scored_again(spark):
    table = pages.parse_results(spark.createDataFrame([('{"pages": [{"page": 1, "lines": [{"id": "L1", "seq": 1, "body": "fine words", "confidence": 1.7}]}]}',)], "result_json string"))
    line = pages.enrich(table.select(F.explode("pages").alias("p")).select("p.*"), X.LATIN).select(F.explode("lines").alias("x")).first().x
    assert (line.layout_confidence, line.confidence, line.needs_review) == (1.0, 0.99, False)


def test_filter_drops_other_scripts_and_repeats(spark):
    rows = filtering.own_script(lines(spark, "கல்வி. ஒளி.", "hello", "ஒளி. மொழி."), X.TAMIL)
    assert [r.body for r in filtering.clean(rows, ["page", "seq"]).orderBy("seq").collect()] == ["கல்வி. ஒளி.", " மொழி."]
    assert tuple(filtering.totals(rows, ["page", "seq"]).first()) == (1, 1, 1, 2)


def test_candidates_sort_before_they_are_cut(spark):
    raw = [("மொழி", 0.2), ("ஒளி", None), ("latin", 0.9), ("கல்வி", 0.9), (" கல்வி ", 0.95), ("தமிழ்", float("nan")), ("வேறு", 0.1)]
    table = spark.createDataFrame([(raw, "வேறு")], "raw array<struct<text:string,score:double>>, before string")
    found = table.select(review.candidates(F.col("raw"), F.col("before"), X.TAMIL).alias("c")).first().c
    assert [(x.text, x.score) for x in found] == [("கல்வி", 0.9), ("ஒளி", 0.5), ("தமிழ்", 0.5)]


def test_search_ranks_and_marks(spark):
    index = search.in_memory(lines(spark, "red fox red fox", "a fox", "blue sky", " "))
    assert [r.seq for r in search.search(index, "fox").collect()] == [1, 2]
    assert [r.seq for r in search.search(index, "red-fox").collect()] == [1]
    assert snippet_of("One red fox and a Fox", [["red"], ["fox"]]) == "One <mark>red</mark> <mark>fox</mark> and a <mark>Fox</mark>"


def test_echoes_of_neighbouring_bands_go(spark):
    rows = [(1, 0, 1, 10, 20, "same words here", 0.9, 0, 40), (1, 1, 1, 12, 20, "same words here", 0.8, 40, 80), (1, 1, 2, 50, 20, "other", 0.9, 40, 80)]
    table = spark.createDataFrame(rows, "page long, band int, line int, y int, h int, body string, confidence double, core0 int, core1 int")
    assert sorted((r.band, r.line) for r in layout.drop_echoes(table).collect()) == [(0, 1), (1, 2)]


def test_exports(spark):
    built = pages.build_pages(lines(spark, "one", "[stub] two", 'q "x", <y>').withColumn("confidence", F.lit(0.9)).withColumn("needs_review", F.lit(False)))
    assert export.txt(built).first().text == 'one\nq "x", <y>\n'
    assert spark.range(1).select(export.csv_field(F.lit('a "b"'))).first()[0] == '"a ""b"""'
    assert "&lt;y&gt;" in export.xml(built).first().text
    assert spark.range(1).select(export.safe_stem(F.lit("தமிழ்.pdf"))).first()[0] == "document"


def test_edit_operations():
    assert edit_operations("kitten", "sitting") == (2, 0, 1)
    assert edit_operations("", "ab") == (0, 0, 2)
    assert edit_operations("ab", "") == (0, 2, 0)


def test_edit_operations_prefer_substitutions_then_deletions():
    import random

    r = random.Random(3)
    for _ in range(150):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [(0, 0, (0, 0, 0))] if i == j == 0 else []
                if i and j:
                    c, _, (s, d, n) = best[i - 1, j - 1]
                    ways.append((c + (a[i - 1] != b[j - 1]), 0, (s + (a[i - 1] != b[j - 1]), d, n)))
                if i:
                    c, _, (s, d, n) = best[i - 1, j]
                    ways.append((c + 1, 1, (s, d + 1, n)))
                if j:
                    c, _, (s, d, n) = best[i, j - 1]
                    ways.append((c + 1, 2, (s, d, n + 1)))
                best[i, j] = min(ways)
        assert edit_operations(a, b) == best[len(a), len(b)][2]


def test_bodies_of_pages_without_lines_and_names(spark):
    rows = [(1, 1, [], "one\n  [stub] nothing\r\ntwo\n"), (1, 2, [(2, "b"), (1, "a")], "x"), (1, 3, [], None)]
    table = spark.createDataFrame(rows, "doc_id int, page int, lines array<struct<seq:int,body:string>>, text string")
    assert [r.bodies for r in export.bodies(table).orderBy("page").collect()] == [["one", "two"], ["a", "b"], []]
    names = {"v1.2.pdf": "v1_2", "a  b_.pdf": "a__b", ".pdf": "pdf", "பக்கம்.pdf": "document"}
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", export.safe_stem(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in found} == names
