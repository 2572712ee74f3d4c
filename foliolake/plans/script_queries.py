"""Queries over lines in another script, saved corrections and uploads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import overlay
from ..sources import files
from .fragments import BLANKS, LINES, WORDS, lines, strip_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Latin letters and what stands for them in lines turned into Tamil: vowels as signs, y as the sign that takes a vowel away, x as a
# place of the block that has no letter, z as a symbol.
LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
TAMIL_LETTERS = "ாகசடெதபமினறலவயொழளரஞஙுணஷ௻்█"
CONSONANTS, SIGNS = "க-ஹ", "ா-ௌௗ"


def tamil_lines(spark, d):
    """The lines of documents in Tamil letters; every fifth says its first word over and over."""
    first = F.regexp_extract("body", r"[^ ]+", 0)
    again = F.concat_ws(" ", first, first, first, first, F.substring("body", 1, 10))
    body = F.when(F.col("seq") % 5 == 0, again).otherwise(F.col("body"))
    return lines(spark, d).select("doc_id", "page", "seq", F.translate(F.lower(body), LATIN_LETTERS, TAMIL_LETTERS).alias("body"))


TAMIL = LINES + rf""",
turned AS (SELECT doc_id, page, seq, translate(lower(CASE WHEN seq % 5 = 0 THEN concat_ws(' ', regexp_extract(body, '[^ ]+'), regexp_extract(body, '[^ ]+'), regexp_extract(body, '[^ ]+'), regexp_extract(body, '[^ ]+'), substr(body, 1, 10)) ELSE body END), '{LATIN_LETTERS}', '{TAMIL_LETTERS}') AS body FROM lines),
sentenced AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '[^.!?\x{{0964}}\x{{0965}}]+[.!?\x{{0964}}\x{{0965}}]*'), lambda s: {strip_sql("s")}), lambda s: s <> '') AS sents, list_sort({WORDS}) AS w,
                     list_transform(range(1, length(body) + 1), lambda i: body[i]) AS c FROM turned)"""


@query(rf"WITH {TAMIL} SELECT doc_id, page, seq, round(len(regexp_extract_all(body, '[\x{{0B83}}-\x{{0BB9}}\x{{0BD0}}]'))::DOUBLE / NULLIF(len(regexp_extract_all(body, '\p{{L}}')), 0), 6) AS share, len(list_filter(range(1, len(c) + 1), lambda i: regexp_matches(c[i], '^[{SIGNS}\x{{0BCD}}]') AND (i = 1 OR NOT regexp_matches(c[i - 1], '^[{CONSONANTS}{SIGNS}]'))))::INTEGER AS orphans, len(regexp_extract_all(body, '[^\x20-\x7E\p{{L}}{BLANKS}\x{{0B80}}-\x{{0BFA}}\x{{2010}}-\x{{2015}}\x{{2018}}\x{{2019}}\x{{201C}}\x{{201D}}\x{{2022}}\x{{2026}}\x{{00AB}}\x{{00BB}}\x{{00B7}}]'))::INTEGER AS odd, (len(sents) - len(list_distinct(sents)))::INTEGER AS repeated, (len(w) >= 4 AND len(list_filter(w, lambda x: x = w[len(w) // 2 + 1])) >= 3 AND 2 * len(list_filter(w, lambda x: x = w[len(w) // 2 + 1])) > len(w)) AS loop FROM sentenced")
def tamil_signals(spark, d):
    """Signs without a letter, letters that don't exist, repeated sentences and words over and over."""
    s = tamil_lines(spark, d).withColumn("s", X.signals(F.col("body"), X.TAMIL))
    return s.select("doc_id", "page", "seq", F.round("s.share", 6).alias("share"), "s.orphans", "s.odd", "s.repeated", "s.loop")


@query("WITH w AS (SELECT p_partkey, p_brand, UNNEST(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1)::INTEGER AS k FROM part), c AS (SELECT p_brand, string_split(p_name, ' ')[1] AS before, arg_min(p_type, p_partkey) AS after FROM part GROUP BY ALL) SELECT p_partkey, k, word, after FROM w LEFT JOIN c ON c.p_brand = w.p_brand AND c.before = w.word")
def first_matching_correction(spark, d):
    """Of a group's corrections the first whose word is the one at hand."""
    parts = table(spark, d, "part")
    words = parts.select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("k", "word")).withColumn("k", F.col("k") + 1)
    saved = parts.select("p_brand", F.col("p_partkey").alias("pos"), F.get(F.split("p_name", " "), 0).alias("before"), F.col("p_type").alias("after"))
    return overlay.first_match(words, saved, "p_brand").select("p_partkey", "k", "word", "after")


@query("WITH c AS (SELECT l_orderkey AS job_id, l_linenumber - 1 AS page, l_suppkey % 5 AS word, CASE l_returnflag WHEN 'A' THEN ' ' ELSE l_linestatus END AS after, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem), g AS (SELECT job_id, COUNT(*) AS n, COUNT(*) FILTER (page >= 1 AND word >= 1 AND after <> ' ') AS good, string_agg(page || ':' || word || ':' || after, ',' ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) FILTER (page >= 1 AND word >= 1 AND after <> ' ') AS kept FROM c GROUP BY job_id) SELECT job_id, CASE WHEN job_id % 7 > 1 THEN COALESCE(kept, '') ELSE '' END AS kept, CASE WHEN job_id % 7 > 1 THEN n - good ELSE 0 END::INTEGER AS skipped, CASE WHEN job_id % 7 = 1 THEN 'unreadable' WHEN job_id % 7 > 1 AND n > good THEN (n - good) || ' bad entries skipped' END AS problem FROM g")
def saved_corrections(spark, d):
    """Saved corrections read back; a job without a file has none, one with a broken file a problem, bad entries are counted."""
    entry = F.struct(
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"),
        F.struct((F.col("l_linenumber") - 1).cast("string").alias("page"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("line"), (F.col("l_suppkey") % 5).cast("string").alias("word"), F.lit("x").alias("before"), F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_linestatus")).alias("after")).alias("c"),
    )
    maps = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.c).alias("corrections"))).alias("json"))
    shown = F.when(F.col("job_id") % 7 == 1, F.lit("[1, 2")).when(F.col("job_id") % 7 > 1, F.col("json"))
    found = files.saved_corrections(maps.select("job_id", shown.alias("json")))
    return found.select("job_id", F.array_join(F.transform("corrections", lambda c: F.concat_ws(":", c.page.cast("string"), c.word.cast("string"), c.after)), ",").alias("kept"), "skipped", "problem")


UPLOAD = "SELECT l_orderkey, l_linenumber, l_partkey, ['png', 'jpg', 'JPEG', 'tif', 'pdf', 'exe', 'tiff', 'PDF'][l_partkey % 8 + 1] AS ext, ['image/png', 'image/jpeg', 'image/jpeg', 'image/tiff', 'application/pdf', 'image/png', 'image/tiff', 'application/pdf'][CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey % 4 ELSE l_partkey % 8 END + 1] AS mime, l_quantity::BIGINT % 49 * 1500000 AS size, l_linenumber % 3 * CASE WHEN l_suppkey % 10 = 0 THEN 60 ELSE 1 END AS files FROM lineitem"


@query(f"WITH u AS ({UPLOAD}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ext = 'exe' THEN 'extension' WHEN mime <> CASE lower(ext) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' ELSE 'application/pdf' END THEN 'type' WHEN files > 1 AND lower(ext) = 'pdf' THEN 'document among images' WHEN files > 100 THEN 'files' WHEN size > 50 * 1024 * 1024 THEN 'size' WHEN size <= 0 THEN 'empty' END AS problem FROM u")
def upload_problems(spark, d):
    """Why files are refused."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = table(spark, d, "lineitem")
    name = F.concat(F.lit("scan.v2."), pick(["png", "jpg", "JPEG", "tif", "pdf", "exe", "tiff", "PDF"], F.col("l_partkey") % 8))
    mime = pick(["image/png", "image/jpeg", "image/jpeg", "image/tiff", "application/pdf", "image/png", "image/tiff", "application/pdf"], F.when(F.col("l_suppkey") % 9 == 0, F.col("l_suppkey") % 4).otherwise(F.col("l_partkey") % 8))
    size = F.col("l_quantity").cast("long") % 49 * 1_500_000
    number = F.col("l_linenumber") % 3 * F.when(F.col("l_suppkey") % 10 == 0, 60).otherwise(1)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", files.upload_problem(name, mime, size, number).alias("problem"))
