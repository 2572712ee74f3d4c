"""The stored index against the embedded engine whose results it stands in for."""

from __future__ import annotations

import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliolake.functions import text as X
from foliolake.functions.udfs import snippet_of
from foliolake.operators import overlay, search

#: Letters that came to the standard, or got their case pairs, after the one that the engine folds by: here they fold by today's.
NEWER = ((0x37F, 0x37F), (0x528, 0x52F), (0x13F8, 0x13FD), (0x1C80, 0x1CBF), (0x1CF2, 0x1CF3), (0x2C2F, 0x2C2F), (0xA698, 0xA69B), (0xA796, 0xA7F5), (0xAB70, 0xABBF), (0x104B0, 0x104D3), (0x10570, 0x10595), (0x10C80, 0x10CB2), (0x118A0, 0x118BF), (0x16E40, 0x16E5F), (0x1E900, 0x1E921))


def engine(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(doc UNINDEXED, page UNINDEXED, seq UNINDEXED, body)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    return con


def test_every_letter_is_a_token_as_in_the_engine(spark):
    letters = [c for c in map(chr, range(1, 0x20000)) if unicodedata.category(c)[0] in "LN" and not any(a <= ord(c) <= b for a, b in NEWER)]
    con = engine([(i, 0, 0, f"{c} x{c}{c}y") for i, c in enumerate(letters)])
    wanted = [[] for _ in letters]
    for term, row in con.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        wanted[row - 1].append(term)
    table = spark.createDataFrame([(i, f"{c} x{c}{c}y") for i, c in enumerate(letters)], "i int, t string")
    got = {r.i: r.k for r in table.select("i", X.tokens(F.col("t")).alias("k")).collect()}
    assert [(hex(ord(c)), got[i], wanted[i]) for i, c in enumerate(letters) if got[i] != wanted[i]] == []
    assert [hex(ord(c)) for i, c in enumerate(letters) if X.plain_tokens(f"{c} x{c}{c}y") != wanted[i]] == []


def test_signs_and_accents_split_as_in_the_engine(spark):
    texts = [f"ab{chr(c)}cd {chr(c)}x" for c in range(0x300, 0x370)] + ["வாலறிவன் நற்றாள்", "éa ́b", "İstanbul ΣΑΣ ſtraße", "a_b-c'd\"e", "xy", "₁₂ Ⅷ ½"]
    con = engine([(i, 0, 0, t) for i, t in enumerate(texts)])
    wanted = [[] for _ in texts]
    for term, row in con.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        wanted[row - 1].append(term)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == wanted and [X.plain_tokens(t) for t in texts] == wanted


QUERIES = ["fox", "red-fox", "Red fox", "the the", '"the', "fox AND", "NEAR(red", "fox*", "élan", "elan the", "கல்வி", "-- fox", "--", "nothing", "the-the-the", "of-the-red"]


def hits(spark, path, q):
    return {(r.doc_id, r.page, r.seq): r.score for r in search.ranked(search.open_index(spark, path), q).collect()}


def check(spark, path, rows):
    con = engine([r for r in rows if r[3].strip()])
    for q in QUERIES:
        match = " ".join('"' + t.replace('"', '""') + '"' for t in q.split())
        wanted = {r[:3]: r[3] for r in con.execute("SELECT doc, page, seq, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        found = hits(spark, path, q)
        assert set(found) == set(wanted), q
        assert all(found[k] == pytest.approx(wanted[k], abs=6e-5) for k in wanted), q


def test_snippets_equal_the_engine():
    r = random.Random(12)
    words = ["the", "red", "fox", "of", "Élan.", "sky:", "a", "red-fox", "the,the", "கல்வி", "x", "y", "z.", "q", "e\u0301e"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + r.choice(["", ".", "  "]) for _ in range(400)]
    con = engine([(i, 0, 0, t) for i, t in enumerate(texts)])
    for q in ("fox", "red-fox", "the the", "elan fox", "the-the of", "கல்வி sky", "z red fox the"):
        match = " ".join('"' + t + '"' for t in q.split())
        wanted = dict(con.execute("SELECT doc, snippet(t, 3, '<mark>', '</mark>', '…', 16) FROM t WHERE t MATCH ?", (match,)))
        assert len(wanted) > 5
        assert [(texts[i], s, snippet_of(texts[i], search.phrases_of(q))) for i, s in wanted.items() if snippet_of(texts[i], search.phrases_of(q)) != s] == [], q


def corpus():
    r = random.Random(4)
    words = ["the", "the", "red", "fox", "of", "Élan", "elan", "கல்வி", "sky", "a", "red-fox", "the,the"]
    return [(d, p, s, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for d in range(1, 13) for p in (1, 2) for s in (1, 2, 3)]


SCHEMA = "doc_id long, page int, seq int, body string"


def test_index_ranks_like_the_engine_and_follows_changes(spark, tmp_path):
    rows, path = corpus(), str(tmp_path / "index")
    search.write(spark.createDataFrame(rows, SCHEMA), path, parts=3, buckets=4)
    check(spark, path, rows)
    # documents 3 and 4 change, 5 goes, 100 comes: parts that hold none of them keep their files
    ids = spark.createDataFrame([(3,), (4,), (5,), (100,)], "doc_id long")
    fresh = [(3, 1, 1, "the red fox of the sky"), (4, 1, 1, "nothing else"), (100, 1, 1, "red-fox élan"), (7, 1, 1, "of no matter: its document isn't named")]
    search.replace_documents(spark.createDataFrame(fresh, SCHEMA), ids, path)
    rows = [r for r in rows if r[0] not in (3, 4, 5)] + fresh[:3]
    check(spark, path, rows)
    # the last documents of all parts go: nothing is found any more
    search.replace_documents(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(d,) for d in range(1, 101)], "doc_id long"), path)
    assert hits(spark, path, "the") == {} and search.open_index(spark, path).lines.count() == 0


def test_a_correction_makes_the_fixed_word_findable(spark, tmp_path):
    raw, fixed, path = "வாழறிவன்", "நீந்தல்", str(tmp_path / "index")
    lines = spark.createDataFrame([(1, 1, 1, f"கற்றதனால் ஆய பயனென்கொல் {raw}"), (2, 1, 1, f"மற்ற {raw}")], SCHEMA)
    final = lambda *saved: overlay.apply(lines, spark.createDataFrame(list(saved), "doc_id long, page int, seq int, word int, pos int, before string, after string")).select("doc_id", "page", "seq", F.col("final_body").alias("body"))
    one = spark.createDataFrame([(1,)], "doc_id long")
    search.write(lines, path, parts=2, buckets=3)
    assert set(hits(spark, path, raw)) == {(1, 1, 1), (2, 1, 1)} and hits(spark, path, fixed) == {}
    search.replace_documents(final((1, 1, 1, 4, 1, raw, fixed)), one, path)
    assert set(hits(spark, path, raw)) == {(2, 1, 1)} and set(hits(spark, path, fixed)) == {(1, 1, 1)}
    assert search.search(search.open_index(spark, path), fixed).first().body.endswith(fixed)
    search.replace_documents(final((1, 1, 1, 4, 1, "பழைய", fixed)), one, path)  # stale
    assert set(hits(spark, path, raw)) == {(1, 1, 1), (2, 1, 1)} and hits(spark, path, fixed) == {}


def test_a_query_reads_its_buckets_and_splits_no_text(spark, tmp_path):
    path = str(tmp_path / "index")
    search.write(spark.createDataFrame(corpus(), SCHEMA), path, parts=3, buckets=4)
    plan = search.search(search.open_index(spark, path), "fox the")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "translate" not in plan
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "positions" in x)
    assert "PartitionFilters: [bucket" in scan and "In(term, [fox,the])" in scan


DOCUMENTS = [(1, "The end of the road, the road of the king\nof the"), (2, "the cat and the dog\n\nof the day of the dog the day"), (None, "of the sea\nthe sea the sea"), (None, "of the hill and the sea below it\nthe"), (None, "no word\nlonger words follow here"), (7, "Élan of the naïve")]
DOCUMENTS += [(i, f"word{i} and more") for i in range(10, 40)]


def as_sql(spark, folder, name):
    import duckdb

    from foliolake.plans import registry

    table = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(DOCUMENTS)], "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    wanted = con.sql(registry.ORACLES[name])
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).select(*wanted.columns).collect()]
    return got, [tuple(r) for r in wanted.fetchall()]


def test_terms_of_documents_without_an_id_are_counted_as_in_sql(spark, tmp_path):
    got, wanted = as_sql(spark, tmp_path, "postings_terms")
    assert sorted(got) == sorted(wanted) and ("sea", 4, 3) not in wanted and ("hill", 1, 1) in wanted


def test_the_tokens_of_a_corpus_are_stored_without_a_shuffle(spark, tmp_path):
    from foliolake.plans import fragments

    as_sql(spark, tmp_path, "search_count")
    index = fragments.index(spark, str(tmp_path))
    assert index.rows.count() == sum(bool(line.strip()) for _, t in DOCUMENTS for line in t.split("\n"))
    lines = fragments.lines(spark, str(tmp_path)).select("doc_id", "page", "seq", "body")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(search.index_lines(lines)) == shuffles(lines)


def test_plain_lines_are_stripped_and_split_as_others_are(spark):
    texts = ["", " ", "\t a b \x0b\x1c\n", "a_b-C'd\"e 09", "x\x00y\x7fz \x1f", "\n\n", " a\n ", "A\x85b\x85", " é a ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select("t", X.strip(F.col("t")), X.tokens(F.col("t")))
    slow = rows.select(F.regexp_replace("t", X.EDGES, ""), F.regexp_extract_all(X.fold(F.col("t")), F.lit(X._TOKEN), F.lit(0)))
    assert [tuple(r)[1:] for r in rows.collect()] == [tuple(r) for r in slow.collect()]


def test_best_lines_of_documents_without_an_id_are_those_of_the_sql(spark, tmp_path):
    got, wanted = as_sql(spark, tmp_path, "search_bm25_topk")
    assert got == wanted and len({r[3] for r in wanted}) == len(wanted) and None in {r[0] for r in wanted}


def test_hits_meet_their_documents_as_in_the_sql(spark, tmp_path):
    got, wanted = as_sql(spark, tmp_path, "search_join_jobs")
    assert wanted and sorted(got) == sorted(wanted) and None not in {r[0] for r in wanted}
