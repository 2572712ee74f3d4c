"""Queries over the relational tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.udfs import character_edits, similarity, word_edits
from ..operators import dictionary, export, jobs, layout, pages, review
from ..streaming import feeds
from .fragments import DICTIONARY, JOBS, LINES, WORDS, lines, log, scratch, table
from .fragments import jobs as job_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {JOBS} SELECT job_id, created_at, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 50")
def job_list_page(spark, d):
    """The second page of the listing."""
    return jobs.newest(job_table(spark, d), 50, 50).select("job_id", "created_at", "status")


@query(f"WITH {JOBS} SELECT job_id, filename, status, mode, created_at, CASE WHEN status = 'done' THEN page_count END AS page_count, CASE WHEN status = 'done' THEN 0 END::BIGINT AS pages_needing_review, CASE WHEN status = 'done' THEN 0 END::BIGINT AS corrections_count, CASE WHEN status = 'error' THEN 'boom ' || job_id END AS error FROM jobs")
def job_conditional_payload(spark, d):
    """Summaries; errors of failed jobs only, counts of finished ones only."""
    j = job_table(spark, d).withColumn("result_json", F.to_json(F.struct(F.concat(F.lit("boom "), F.col("job_id").cast("string")).alias("error"))))
    return jobs.listed(j.withColumn("pages_needing_review", F.lit(0).cast("long")).withColumn("corrections_count", F.lit(None).cast("long")))


@query(f"WITH {JOBS} SELECT status, COUNT(*) AS n, COUNT(DISTINCT sha256) AS contents FROM jobs GROUP BY status")
def job_counts(spark, d):
    """A1, A3: jobs and contents by state."""
    return job_table(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("contents"))


@query(f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256, mode ORDER BY created_at DESC, job_id DESC) AS k FROM jobs WHERE status = 'done') SELECT sha256, mode, job_id FROM r WHERE k = 1 AND usable")
def dedup_latest_done(spark, d):
    """The job whose result an upload of the same content and mode gets."""
    return jobs.latest_done(job_table(spark, d)).select("sha256", "mode", "job_id")


@query("SELECT sha256(text) AS sha256, MIN(doc_id) AS first_id, COUNT(*) AS copies FROM documents GROUP BY 1 HAVING COUNT(*) > 1")
def exact_duplicates(spark, d):
    """Contents that occur twice or more."""
    return jobs.duplicates(table(spark, d, "documents"))


@query("SELECT l_orderkey, sha256(string_agg(sha256(l_partkey::VARCHAR), chr(10) ORDER BY l_linenumber, sha256(l_partkey::VARCHAR))) AS sha256 FROM lineitem GROUP BY l_orderkey")
def combined_digest(spark, d):
    """One digest for the ordered files of a job."""
    files = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    return jobs.combined_sha256(files, "l_orderkey", "l_linenumber", "digest")


@query(f"WITH {JOBS}, i AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) SELECT job_id FROM jobs WHERE status = 'done' AND job_id NOT IN (SELECT l_orderkey FROM i)")
def unindexed_jobs_anti(spark, d):
    """Finished jobs without an indexed line."""
    from ..operators import search

    index = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("doc_id"))
    return search.unindexed(job_table(spark, d).withColumnRenamed("job_id", "doc_id"), index).select(F.col("doc_id").alias("job_id"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'uploading' ELSE 'processing' END AS status FROM events")
def status_aliases(spark, d):
    """Other services' words for states."""
    words = F.create_map(*[F.lit(x) for x in ("purchase", " OK ", "error", "Fail", "view", "pending", "click", "in_flight", "signup", "finished")])
    return table(spark, d, "events").select("event_id", jobs.status(words[F.col("event_type")]).alias("status"))


@query("SELECT l_orderkey, l_linenumber, LEAST(99, floor(l_quantity::BIGINT * 100 / 50))::INTEGER AS percent FROM lineitem")
def progress_percent(spark, d):
    """Progress in percent, never done before the end."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", jobs.progress(F.col("l_quantity").cast("long"), F.lit(50)).alias("percent"))


@query("SELECT l_orderkey, l_linenumber, SUM(l_extendedprice) OVER w AS used, SUM(l_extendedprice) OVER w <= 100000 AS fits FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)".replace("SUM(l_extendedprice) OVER w AS used", "round(SUM(l_extendedprice) OVER w, 2) AS used"))
def running_budget(spark, d):
    """A byte budget over the files of an upload."""
    files = dictionary.running_budget(table(spark, d, "lineitem"), "l_extendedprice", "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], 100000)
    return files.select("l_orderkey", "l_linenumber", F.round("used", 2).alias("used"), "fits")


@query(f"WITH {DICTIONARY} SELECT * FROM dict")
def dictionary_fold(spark, d):
    """The dictionary from its log."""
    return dictionary.fold(log(table(spark, d, "events")))


@query(f"WITH {DICTIONARY} SELECT before, after, accepts, skips FROM dict WHERE accepts >= 2 AND accepts > skips")
def dictionary_gate(spark, d):
    """What may be suggested."""
    return dictionary.gated(dictionary.fold(log(table(spark, d, "events")))).select("before", "after", "accepts", "skips")


@query(f"WITH {DICTIONARY} SELECT before, accepts, updated_at FROM dict ORDER BY accepts DESC, updated_at DESC, before LIMIT 200")
def dictionary_top(spark, d):
    """The listing of the dictionary."""
    return dictionary.top(dictionary.fold(log(table(spark, d, "events")))).select("before", "accepts", "updated_at")


@query(f"WITH {DICTIONARY}, s AS (SELECT before, 'server' AS origin FROM dict WHERE accepts > 1), l AS (SELECT before, 'local' AS origin FROM dict) SELECT * FROM s UNION ALL SELECT * FROM l WHERE before NOT IN (SELECT before FROM s)")
def dictionary_overlay(spark, d):
    """Local and server dictionaries together."""
    every = dictionary.fold(log(table(spark, d, "events")))
    return dictionary.overlay(every.select("before", F.lit("local").alias("origin")), every.where("accepts > 1").select("before", F.lit("server").alias("origin")))


@query("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_limit_window(spark, d):
    """Calls of a key in the last day, to the second."""
    return dictionary.sliding_count(table(spark, d, "events"), 86400).select("event_id", "n")


@query("SELECT event_id, COALESCE(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM events")
def breaker_state(spark, d):
    """Whether the key's breaker is open."""
    return dictionary.breaker(table(spark, d, "events"), F.col("event_type") == "error").select("event_id", "open")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def result_json_scan(spark, d):
    """Values out of stored JSON."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 80 AND c_nationkey / 25.0 >= 0.2 AND c_nationkey <= 15 THEN 'FAST' ELSE 'HEAVY' END AS routed, CASE c_mktsegment WHEN 'BUILDING' THEN 'FAST' WHEN 'MACHINERY' THEN 'HEAVY' ELSE CASE WHEN c_acctbal >= 80 AND c_nationkey / 25.0 >= 0.2 AND c_nationkey <= 15 THEN 'FAST' ELSE 'HEAVY' END END AS profile FROM customer")
def route_profile(spark, d):
    """The profile of a page from its metrics, and as a mode forces it."""
    routed = pages.profile(F.col("c_acctbal"), F.col("c_nationkey") / 25.0, F.col("c_nationkey"), F.lit(0))
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "light").when(F.col("c_mktsegment") == "MACHINERY", "heavy").otherwise("auto")
    return table(spark, d, "customer").select("c_custkey", routed.alias("routed"), pages.forced_profile(mode, routed).alias("profile"))


@query("SELECT p_partkey, CASE WHEN (p_size * 5.0 - 1) / 255 >= 0.25 AND p_retailprice >= 240 THEN 'CLEAN' ELSE 'DAMAGED' END AS gate FROM part")
def repair_gate(spark, d):
    """The gate before repair."""
    return table(spark, d, "part").select("p_partkey", pages.repair_gate(F.lit(1), F.col("p_retailprice"), F.col("p_size") * 5.0).alias("gate"))


@query("WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, v[LEAST(len(v) - 1, floor(0.9 * len(v))::BIGINT) + 1] AS p90, v[-1] AS top FROM s")
def threshold_percentiles(spark, d):
    """Percentiles by place, without interpolation; ranks come from a window, so no group is collected."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    counted = rows.groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("l_returnflag").orderBy("l_extendedprice")
    placed = counted.withColumn("upto", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy("l_returnflag")))
    place = F.least(F.col("total") - 1, F.floor(F.lit(0.9) * F.col("total")))
    return placed.groupBy("l_returnflag").agg(F.min(F.when(F.col("upto") > place, F.col("l_extendedprice"))).alias("p90"), F.max("l_extendedprice").alias("top"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 900 AS px, CASE l_suppkey % 4 WHEN 1 THEN 1200 - l_suppkey % 700 - 30 WHEN 2 THEN 1000 - l_partkey % 900 - 60 WHEN 3 THEN l_suppkey % 700 ELSE l_partkey % 900 END AS x, CASE l_suppkey % 4 WHEN 1 THEN l_partkey % 900 WHEN 2 THEN 1200 - l_suppkey % 700 - 30 WHEN 3 THEN 1000 - l_partkey % 900 - 60 ELSE l_suppkey % 700 END AS y FROM lineitem")
def rotate_boxes(spark, d):
    """Boxes on turned pages."""
    x, y = F.col("l_partkey") % 900, F.col("l_suppkey") % 700
    box = G.rotated(x, y, F.lit(60).cast("long"), F.lit(30).cast("long"), F.lit(1000).cast("long"), F.lit(1200).cast("long"), (F.col("l_suppkey") % 4) * 90)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("px"), box["x"].alias("x"), box["y"].alias("y"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN ok AND w >= 16 AND h >= 16 THEN x END AS x, CASE WHEN ok AND w >= 16 AND h >= 16 THEN w END AS w FROM (SELECT l_orderkey, l_linenumber, l_discount >= 0 AND l_discount + l_tax * 5 <= 1 AND l_tax > 0 AS ok, floor(l_discount * 1600)::BIGINT AS x, LEAST(ceil((l_discount + l_tax * 5) * 1600), 1600)::BIGINT - floor(l_discount * 1600)::BIGINT AS w, LEAST(ceil(0.5::DOUBLE * 1200), 1200)::BIGINT AS h FROM lineitem)")
def crop_pixels(spark, d):
    """Crops in whole pixels."""
    box = G.crop_pixels(F.col("l_discount"), F.lit(0.0), F.col("l_discount") + F.col("l_tax") * 5, F.lit(0.5), F.lit(1600).cast("long"), F.lit(1200).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box["x"].alias("x"), box["w"].alias("w"))


@query("SELECT p_partkey, p_size > 0 AND GREATEST(p_size * 10.0, p_retailprice) / LEAST(p_size * 10.0, p_retailprice) > 2.5 AS extreme, round(CASE WHEN GREATEST(p_size * 10.0, p_retailprice) >= 1000 THEN 1.0 ELSE LEAST(2.0, 1600.0 / GREATEST(p_size * 10.0, p_retailprice)) END, 6) AS factor FROM part")
def page_scaling(spark, d):
    """Extreme aspects and factors of enlargement."""
    w, h = F.col("p_size") * 10.0, F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", G.extreme_aspect(w, h).alias("extreme"), F.round(G.upscale_factor(w, h), 6).alias("factor"))


@query("SELECT p_partkey, GREATEST(1, round(p_size * 100 * LEAST(1.0::DOUBLE, 1600.0::DOUBLE / GREATEST(p_size * 100, 1000)))::INTEGER) AS w, GREATEST(1, round(1000 * LEAST(1.0::DOUBLE, 1600.0::DOUBLE / GREATEST(p_size * 100, 1000)))::INTEGER) AS h FROM part")
def resize_cap(spark, d):
    """Sizes under the cap."""
    box = G.capped(F.col("p_size") * 100, F.lit(1000))
    return table(spark, d, "part").select("p_partkey", box["w"].alias("w"), box["h"].alias("h"))


MAPPED = """WITH p AS (SELECT p_partkey, radians(p_size % 31 - 15) AS a, 1 + p_size % 3 * 0.5::DOUBLE AS s, p_size * 4.0::DOUBLE AS x, 10.0::DOUBLE + p_partkey % 90 AS y FROM part),
c AS (SELECT p_partkey, UNNEST([x, x + 40, x, x + 40]) / s - 50 AS u, UNNEST([y, y, y + 30, y + 30]) / s - 60 AS v, a FROM p),
t AS (SELECT p_partkey, round(MIN(u * cos(a) - v * sin(a)) + 50 + 10)::INTEGER AS x, round(MIN(u * sin(a) + v * cos(a)) + 60 + 20)::INTEGER AS y, round(MAX(u * cos(a) - v * sin(a)) + 50 + 10)::INTEGER AS x1, round(MAX(u * sin(a) + v * cos(a)) + 60 + 20)::INTEGER AS y1 FROM c GROUP BY p_partkey)
SELECT p_partkey, x, y, GREATEST(1, x1 - x) AS w, GREATEST(1, y1 - y) AS h FROM t"""


@query(MAPPED)
def page_mapping(spark, d):
    """Boxes of a prepared image, scaled and turned by up to 15 degrees either way, back on the page."""
    size, scale, angle = F.col("p_size"), 1 + F.col("p_size") % 3 * 0.5, (F.col("p_size") % 31 - 15).cast("double")
    box = G.to_page(size * 4.0, 10.0 + F.col("p_partkey") % 90, F.lit(40), F.lit(30), scale, angle, F.lit(50.0), F.lit(60.0), F.lit(10), F.lit(20))
    return table(spark, d, "part").select("p_partkey", box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, 1 - l_discount AS c, MIN(1 - l_discount) OVER (PARTITION BY l_orderkey) AS lo, MAX(1 - l_discount) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(GREATEST(1 - c, (CASE WHEN hi - lo > 0 THEN (hi - c) / (hi - lo) ELSE 0 END) * LEAST(1.0::DOUBLE, (hi - lo) / 0.15::DOUBLE)), 6) AS damage FROM r")
def heat_damage(spark, d):
    """Damage against a page's range of confidence."""
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").withColumn("c", 1 - F.col("l_discount"))
    return rows.select("l_orderkey", "l_linenumber", G.heat(F.col("c"), F.min("c").over(w), F.max("c").over(w)).alias("damage"))


@query(f"WITH {LINES}, w AS (SELECT doc_id, page, seq, {WORDS} AS x FROM lines), e AS (SELECT doc_id, page, seq, UNNEST(x) AS word, generate_subscripts(x, 1)::INTEGER AS k, list_sum(list_transform(x, lambda v: length(v))) AS total FROM w), a AS (SELECT *, COALESCE(SUM(length(word)) OVER (PARTITION BY doc_id, page, seq ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e) SELECT doc_id, page, seq, k, word, round(10 + ahead * (600.0::DOUBLE / total), 6) AS word_x, round(length(word) * (600.0::DOUBLE / total), 6) AS word_w FROM a")
def word_boxes(spark, d):
    """Boxes of words; a running sum over one line's words."""
    each = lines(spark, d).select("doc_id", "page", "seq", F.posexplode(X.words(F.col("body"))).alias("k", "word")).withColumn("n", F.length("word"))
    line = Window.partitionBy("doc_id", "page", "seq")
    ahead = F.coalesce(F.sum("n").over(line.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unit = F.lit(600.0) / F.sum("n").over(line)
    return each.select("doc_id", "page", "seq", (F.col("k") + 1).alias("k"), "word", F.round(10 + ahead * unit, 6).alias("word_x"), F.round(F.col("n") * unit, 6).alias("word_w"))


@query("SELECT a.l_orderkey AS page, a.l_linenumber AS band, a.l_partkey::INTEGER AS a_line, b.l_partkey::INTEGER AS b_line, round(GREATEST(LEAST(a.l_partkey % 50 + a.l_quantity, b.l_partkey % 50 + b.l_quantity) - GREATEST(a.l_partkey % 50, b.l_partkey % 50), 0) / LEAST(a.l_quantity, b.l_quantity), 6) AS overlap FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE LEAST(a.l_partkey % 50 + a.l_quantity, b.l_partkey % 50 + b.l_quantity) > GREATEST(a.l_partkey % 50, b.l_partkey % 50)")
def band_overlap(spark, d):
    """Lines of neighbouring bands that overlap."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("band"), F.col("l_partkey").cast("int").alias("line"), (F.col("l_partkey") % 50).alias("y"), F.col("l_quantity").alias("h"), F.lit("").alias("body"))
    return layout.band_overlaps(rows).select("page", "band", "a_line", "b_line", "overlap")


@query("WITH b AS (SELECT conv_id, turn, role, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS x FROM conversations) SELECT conv_id AS page_num, turn AS block, (k - 1)::INTEGER AS k, trim(body) AS body, [100, round(turn * 50 + 40.0 * (k - 1) / n)::INTEGER, 500, round(40.0 / n)::INTEGER] AS bbox FROM (SELECT conv_id, turn, UNNEST(x) AS body, generate_subscripts(x, 1) AS k, len(x) AS n FROM b)".replace("[100, round(turn * 50 + 40.0 * (k - 1) / n)::INTEGER, 500, round(40.0 / n)::INTEGER] AS bbox", "round(turn * 50 + 40.0::DOUBLE * (k - 1) / n)::INTEGER AS y, round(40.0::DOUBLE / n)::INTEGER AS h"))
def block_to_line_boxes(spark, d):
    """Lines of blocks with their boxes on the page."""
    corner = lambda v: v.cast("double")
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("page_num"), F.lit(2000).alias("image_width"), F.lit(3000).alias("image_height"), F.col("turn").alias("block_id"), F.col("turn").alias("reading_order"), "text", F.lit(0.9).alias("confidence"),
        F.struct(corner(F.lit(200)).alias("x1"), corner(F.col("turn") * 100).alias("y1"), corner(F.lit(1200)).alias("x2"), corner(F.col("turn") * 100 + 80).alias("y2")).alias("coordinates"),
    )
    return layout.line_boxes(rows, 1000, 1500).select("page_num", F.col("block_id").alias("block"), "k", "body", F.get("bbox", 1).alias("y"), F.get("bbox", 3).alias("h"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS x FROM part), e AS (SELECT p_partkey, UNNEST(x) AS t, generate_subscripts(x, 1) AS k, x[1] AS b FROM w), g AS (SELECT p_partkey, t, MIN(k) AS k FROM e WHERE t <> b AND t <> '' AND regexp_matches(t, '[A-Za-z]') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(LEAST(1.0::DOUBLE, length(t) / 10.0::DOUBLE), 3) DESC, k) AS n FROM g) SELECT p.p_partkey, COALESCE(string_agg(t, '|' ORDER BY n) FILTER (n <= 3), '') AS best FROM part p LEFT JOIN r USING (p_partkey) GROUP BY p.p_partkey")
def candidate_topk(spark, d):
    """Cleaned candidates."""
    words = F.split("p_name", " ")
    raw = F.transform(words, lambda w: F.struct(w.alias("text"), (F.length(w) / 10.0).alias("score")))
    found = review.candidates(raw, F.get(words, 0), X.LATIN)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: x.text), "|").alias("best"))


@query("SELECT c_custkey, trim(regexp_replace('_' || c_name || ' v1.2  b_', '[^A-Za-z0-9_-]', '_', 'g'), '_') AS stem FROM customer")
def safe_names(spark, d):
    """Names of downloads."""
    return table(spark, d, "customer").select("c_custkey", export.safe_stem(F.concat(F.lit("_"), "c_name", F.lit(" v1.2  b_.pdf"))).alias("stem"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::INTEGER AS edits, round(levenshtein(p_name, p_type) / length(p_name)::DOUBLE, 6) AS cer FROM part")
def cer_pairs(spark, d):
    """Character error rates."""
    edits = F.levenshtein("p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", edits.alias("edits"), F.round(edits / F.length("p_name"), 6).alias("cer"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS total FROM part")
def edit_operations(spark, d):
    """Substitutions, deletions and insertions sum to the distance."""
    e = character_edits("p_name", "p_type")
    return table(spark, d, "part").withColumn("e", e).select("p_partkey", (F.col("e.substituted") + F.col("e.deleted") + F.col("e.inserted")).cast("long").alias("total"))


@query()
def word_error_rates(spark, d):
    """Word operations between neighbouring turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next", F.lead("text").over(w)).where("next is not null")
    return rows.withColumn("e", word_edits("text", "next")).select("conv_id", "turn", "e.*")


@query()
def sequence_similarity(spark, d):
    """Matching blocks of part names and types."""
    return table(spark, d, "part").select("p_partkey", F.round(similarity("p_name", "p_type"), 6).alias("ratio"))


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^\\D*'), regexp_extract(p_brand, '\\d+')::BIGINT, p_partkey) AS place FROM part".replace("row_number() OVER (ORDER BY regexp_extract(p_brand, '^\\D*'), regexp_extract(p_brand, '\\d+')::BIGINT, p_partkey) AS place", "lower(regexp_extract(p_brand, '^\\D*')) || lpad(regexp_extract(p_brand, '\\d+'), 20, '0') AS key"))
def natural_order(spark, d):
    """Keys that sort names by their numbers."""
    return table(spark, d, "part").select("p_partkey", "p_brand", X.natural_key(F.col("p_brand")).alias("key"))


@query("SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL")
def receipt_by_tier(spark, d):
    """Corrections of each tier, from maps back to rows."""
    maps = review.tiers(table(spark, d, "orders"), "o_custkey", "o_orderpriority")
    return maps.select("o_custkey", F.explode("tiers").alias("o_orderpriority", "n"))


@query("SELECT l_suppkey, COALESCE(MIN(l_linenumber) FILTER (l_linenumber > 3), MIN(l_linenumber)) AS page FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey")
def next_pending_page(spark, d):
    """The next page with work, from the first again at the end."""
    rows = table(spark, d, "lineitem").where("l_quantity > 45").withColumn("page", F.col("l_linenumber"))
    return rows.groupBy("l_suppkey").agg(review.next_page(rows, F.lit(3)).alias("page"))


@query("SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def pending_elsewhere(spark, d):
    """Unfinished items by group."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DICTIONARY} SELECT before, after, accepts, skips, updated_at FROM dict")
def dictionary_fold_stream(spark, d):
    """R1, R2, R8 as a stream: words with their state, events once each in any order; a table with one row a word."""
    found = feeds.folded_log(spark, d, f"{scratch(spark)}/fold-{uuid.uuid4().hex}")
    return found.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("WITH j AS (SELECT user_id AS job_id, COALESCE(arg_max(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' ELSE 'error' END, (ts, event_id)) FILTER (event_type IN ('signup', 'purchase', 'error')), 'pending') AS status, COUNT(*) FILTER (event_type = 'click') AS pages_done, MAX(ts) AS updated_at FROM events GROUP BY user_id) SELECT job_id, CASE WHEN status = 'pending' AND updated_at + INTERVAL 2 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events) THEN 'lost' ELSE status END AS status, pages_done, updated_at FROM j")
def job_status_stream(spark, d):
    """The status of jobs and the pages done, with a timer for those that nothing is heard of."""
    found = feeds.job_feed(spark, d, f"{scratch(spark)}/jobs-{uuid.uuid4().hex}")
    return found.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def event_windows_stream(spark, d):
    """Windowed counts with a watermark."""
    return feeds.windowed_counts(spark, d, f"{scratch(spark)}/windows-{uuid.uuid4().hex}")
