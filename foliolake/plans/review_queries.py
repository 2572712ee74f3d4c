"""Queries of batch review, states and labels, script and drawing, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import drawing, script
from ..functions import text as X
from ..operators import batch, export, jobs, layout, overlay, pages, states
from ..sources import tables
from .fragments import CORRECTIONS, JOBS, LINES, WORDS, corrections, lines, table
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


PLACED = (
    CORRECTIONS
    + f""",
placed AS (SELECT doc_id, page, seq, UNNEST(w) AS word, generate_subscripts(w, 1)::INTEGER AS place, CASE seq % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 ELSE 0.99 END::DOUBLE AS confidence
           FROM (SELECT doc_id, page, seq, {WORDS} AS w FROM lines)),
saved AS (SELECT doc_id, page, seq, word AS place, before, after FROM latest),
fixed AS (SELECT * FROM saved WHERE page = 1),
known AS (SELECT before, arg_max(after, (doc_id, page, seq, word)) AS after FROM corrections WHERE pos = 2 AND before <> after GROUP BY before)"""
)


def placed(spark, d):
    """Every word of the lines with its place, and a confidence that falls in all bands."""
    own = lines(spark, d).select("doc_id", "page", "seq", F.posexplode(X.words(F.col("body"))).alias("k", "word"))
    at = F.col("seq") % 4
    confidence = F.when(at == 0, 0.6).when(at == 1, 0.85).when(at == 2, 0.9).otherwise(0.99)
    return own.select("doc_id", "page", "seq", "word", (F.col("k") + 1).alias("place"), confidence.alias("confidence"))


def saved(spark, d):
    return overlay.latest(corrections(spark, d)).withColumnRenamed("word", "place")


def known(spark, d):
    second = corrections(spark, d).where("pos = 2")
    return batch.taught(second.withColumn("at", F.struct("doc_id", "page", "seq", "word")))


def suggested(spark, d):
    """Words with what may be shown for them: candidates at first places, stale ones on words of two letters, pending corrections on every third line."""
    words = placed(spark, d)
    first = words.where("place = 1")
    word = F.col("word")
    each = [(F.concat(word, F.lit("y")), 0.4), (F.reverse(word), 0.9), (word, 0.99), (F.concat(word, F.lit("y")), 0.95), (F.concat(word, F.lit("x")), None)]
    found = F.array(*[F.struct(t.alias("text"), F.lit(s).cast("double").alias("score"), F.lit("rule").alias("source")) for t, s in each])
    made = first.select(*batch.PLACE, F.when(F.length("word") == 2, "?").otherwise(word).alias("before"), found.alias("candidates"))
    under = F.col("seq") % 3 == 0
    words = words.withColumn("pending", F.when(under, F.concat("word", F.lit("!")))).withColumn("tier", F.when(under, "T2"))
    return batch.attach(words, made)


def restored(spark, d):
    words = placed(spark, d)
    changed = F.when(F.length("word") == 3, F.col("word")).otherwise(F.concat("word", F.lit("+")))
    found = words.where("place = 1 and seq % 2 = 0").select(*batch.PLACE, F.when(F.length("word") == 2, "?").otherwise(F.col("word")).alias("before"), changed.alias("after"))
    return batch.prefilled(suggested(spark, d), found, saved(spark, d).where("page = 1"))


def ticked(spark, d):
    words = placed(spark, d).where("place <= 2 and seq % 5 = 0")
    return words.select(*batch.PLACE, F.when(F.length("word") == 2, "?").otherwise(F.col("word")).alias("before"), F.concat("word", F.lit("~")).alias("after"))


_LATIN = r"A-Za-z\x{00C0}-\x{024F}"


@query(f"WITH {PLACED} SELECT doc_id, page, seq, place, word, NOT regexp_matches(word, '[{_LATIN}]') AS skipped FROM placed WHERE confidence < 0.8 AND (doc_id, page, seq, place) NOT IN (SELECT (doc_id, page, seq, place) FROM fixed) AND word NOT IN (SELECT before FROM known)".replace("(SELECT (doc_id, page, seq, place) FROM fixed)", "(SELECT doc_id, page, seq, place FROM fixed)"))
def batch_targets(spark, d):
    """Words a batch run asks about; those without a letter of the script are only counted."""
    found = batch.open_words(placed(spark, d), saved(spark, d).where("page = 1"), known(spark, d), X.LATIN)
    return found.select("doc_id", "page", "seq", "place", "word", "skipped")


@query(f"WITH {PLACED} SELECT doc_id, page, seq, place, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq, place) AS shown_at, row_number() OVER (PARTITION BY doc_id ORDER BY page, 'L' || seq, place) AS saved_at FROM saved")
def corrections_in_order(spark, d):
    """The listing by numbers, and the saved map's order by letters."""
    found = batch.listed(saved(spark, d)).withColumnRenamed("at", "shown_at")
    return batch.listed(found, by_number=False).select("doc_id", "page", "seq", "place", F.col("shown_at").cast("long").alias("shown_at"), F.col("at").cast("long").alias("saved_at"))


ATTACHED = (
    PLACED
    + """,
offers AS (SELECT doc_id, page, seq, place, word, text, source, row_number() OVER (PARTITION BY doc_id, page, seq, place ORDER BY grp, COALESCE(score, -1) DESC, k) AS r FROM (
  SELECT *, 0 AS grp, 0 AS k, word || '!' AS text, NULL::DOUBLE AS score, 'rule' AS source FROM placed WHERE seq % 3 = 0
  UNION ALL SELECT *, 1, 1, word || 'y', 0.4, 'rule' FROM placed WHERE place = 1 AND length(word) <> 2
  UNION ALL SELECT *, 1, 2, reverse(word), 0.9, 'rule' FROM placed WHERE place = 1 AND length(word) <> 2
  UNION ALL SELECT *, 1, 4, word || 'y', 0.95, 'rule' FROM placed WHERE place = 1 AND length(word) <> 2
  UNION ALL SELECT *, 1, 5, word || 'x', NULL, 'rule' FROM placed WHERE place = 1 AND length(word) <> 2) WHERE text <> word),
single AS (SELECT doc_id, page, seq, place, text, MIN(r) AS r FROM offers GROUP BY ALL),
attached AS (SELECT p.*, s.shown, CASE WHEN seq % 3 = 0 THEN word || '!' ELSE s.best END AS prefill FROM placed p LEFT JOIN (
  SELECT doc_id, page, seq, place, list(text ORDER BY r) AS shown, arg_min(text, r) AS best FROM single GROUP BY ALL) s USING (doc_id, page, seq, place)),
found AS (SELECT doc_id, page, seq, place, CASE WHEN length(word) = 2 THEN '?' ELSE word END AS before, CASE WHEN length(word) = 3 THEN word ELSE word || '+' END AS after FROM placed WHERE place = 1 AND seq % 2 = 0),
marked AS (SELECT a.*, f.after, COALESCE(f.before = a.word AND f.after <> a.word AND x.place IS NULL, false) AS restored
  FROM attached a LEFT JOIN found f USING (doc_id, page, seq, place) LEFT JOIN fixed x USING (doc_id, page, seq, place))"""
)


@query(f"WITH {ATTACHED} SELECT doc_id, page, seq, place, COALESCE(array_to_string(shown, '|'), '') AS shown, prefill FROM attached")
def suggestion_attach(spark, d):
    """What is shown for every word, the pending correction first, stale suggestions left out."""
    return suggested(spark, d).select(*batch.PLACE, F.array_join(F.transform("shown", lambda c: c.text), "|").alias("shown"), "prefill")


@query(f"WITH {ATTACHED} SELECT doc_id, page, seq, place, restored, CASE WHEN restored THEN after ELSE prefill END AS prefill, CASE WHEN restored THEN array_to_string(list_prepend(after, COALESCE(shown, [])), '|') ELSE COALESCE(array_to_string(shown, '|'), '') END AS shown FROM marked")
def prefill_restore(spark, d):
    """Findings of a batch run head the lists of open words that still read the same."""
    return restored(spark, d).select(*batch.PLACE, "restored", "prefill", F.array_join(F.transform("shown", lambda c: c.text), "|").alias("shown"))


@query(f"WITH {ATTACHED} SELECT DISTINCT ON (doc_id) doc_id, page, seq, place, word FROM marked WHERE restored ORDER BY doc_id, page, seq, place")
def first_prefilled(spark, d):
    """The first prefilled word of each document."""
    return batch.first_open(restored(spark, d))


TICKED = PLACED + """,
ticked AS (SELECT doc_id, page, seq, place, CASE WHEN length(word) = 2 THEN '?' ELSE word END AS before, word || '~' AS after FROM placed WHERE place <= 2 AND seq % 5 = 0),
good AS (SELECT t.* FROM ticked t WHERE page <> 1 OR (before <> '?' AND NOT EXISTS (SELECT 1 FROM saved s WHERE (s.doc_id, s.page, s.seq, s.place) = (t.doc_id, t.page, t.seq, t.place)))),
applied AS (SELECT *, true AS changed FROM good UNION ALL SELECT *, false FROM saved s WHERE NOT EXISTS (SELECT 1 FROM good t WHERE (s.doc_id, s.page, s.seq, s.place) = (t.doc_id, t.page, t.seq, t.place)))"""


@query(f"WITH {TICKED} SELECT doc_id, page, seq, place, before, after, changed FROM applied")
def batch_apply(spark, d):
    """Ticked fixes over the saved ones."""
    return batch.apply_ticked(saved(spark, d), ticked(spark, d), placed(spark, d), 1)


@query(f"WITH {TICKED} SELECT before, arg_max(after, (doc_id, page, seq, place)) AS after FROM applied WHERE before <> after GROUP BY before")
def taught_dictionary(spark, d):
    """V5: the reviewer's own dictionary from all fixes."""
    fixes = batch.apply_ticked(saved(spark, d), ticked(spark, d), placed(spark, d), 1)
    return batch.taught(fixes.withColumn("at", F.struct(*batch.PLACE)))


@query(f"WITH {PLACED} SELECT doc_id, page, seq, place, word, k.after FROM placed p JOIN known k ON k.before = p.word WHERE confidence < 0.95 AND place % 7 <> 0 AND (doc_id, page, seq, place) NOT IN (SELECT doc_id, page, seq, place FROM fixed)")
def dictionary_reapply(spark, d):
    """The dictionary's changes on loading, without fixed words and those undone before (every seventh place)."""
    words = placed(spark, d)
    left, skips = batch.undone(saved(spark, d).where("page = 1"), words.where("place % 7 = 0 and page <> 1"))
    skips = skips.unionByName(words.where("place % 7 = 0 and page = 1").select(*batch.PLACE))
    return batch.reapplied(words, known(spark, d), left, skips).select(*batch.PLACE, "word", "after")


@query("SELECT conv_id, turn, COALESCE(lead(turn) OVER w, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS next, COALESCE(lag(turn) OVER w, last_value(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def queue_steps(spark, d):
    """The next and the previous item, round the ends."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    back = batch.neighbour(rows, "conv_id", "turn", -1).withColumnRenamed("next", "last")
    return batch.neighbour(back, "conv_id", "turn").select("conv_id", "turn", "next", "last")


@query("SELECT event_id, user_id FROM (SELECT *, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events) WHERE n IS NULL OR n - epoch_ms(ts) >= 3600000")
def settled_saves(spark, d):
    """Saves that an hour of quiet follows."""
    saves = table(spark, d, "events").select(F.col("event_id"), "user_id", F.col("event_id").alias("save_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return batch.settled(saves, "user_id", 3600000).select("event_id", "user_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def status_feed(spark, d):
    """The last state of each job."""
    changes = table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("change_id"))
    return states.status_feed(changes, "user_id").select("user_id", "status")


PAGE_FLAGS = "CASE c_nationkey % 3 WHEN 0 THEN 'FAST' WHEN 1 THEN 'HEAVY' END AS profile, c_acctbal < 2000 AS review, CASE WHEN c_custkey % 5 < 2 THEN c_custkey % 5 = 0 END AS prepared, c_custkey % 7 > 1 AS loaded, 0.7 + c_custkey % 4 * 0.0625 AS confidence"


@query(f"SELECT c_custkey, CASE WHEN profile = 'HEAVY' AND (COALESCE(prepared, false) OR loaded) THEN 'repaired' WHEN profile = 'FAST' AND NOT review THEN 'clean' WHEN prepared THEN 'precomputed' WHEN loaded THEN 'ready' ELSE 'queued' END AS state, CASE WHEN (review OR COALESCE(profile = 'HEAVY', false)) AND confidence < 0.875 THEN 'doubt' WHEN confidence >= 0.95 THEN 'auto' WHEN confidence >= 0.8 THEN 'ok' ELSE 'doubt' END AS bin, CASE WHEN c_custkey % 11 = 0 THEN 'demo' WHEN c_custkey % 4 = 1 THEN 'local' WHEN review THEN 'error' WHEN loaded AND c_nationkey > 5 THEN 'unsynced' ELSE 'saved' END AS export FROM (SELECT *, {PAGE_FLAGS} FROM customer)")
def page_states(spark, d):
    """States of pages, bands on pages for review, states of exports."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    profile = F.when(nation % 3 == 0, "FAST").when(nation % 3 == 1, "HEAVY")
    review, loaded = F.col("c_acctbal") < 2000, key % 7 > 1
    job = F.when(key % 11 != 0, key.cast("string"))
    return table(spark, d, "customer").select(
        "c_custkey",
        states.page_state(profile, review, F.when(key % 5 < 2, key % 5 == 0), loaded).alias("state"),
        states.review_bin(0.7 + key % 4 * 0.0625, profile, review, 0.875).alias("bin"),
        states.export_state(job, F.when(key % 4 == 1, "local"), review, loaded, nation - 5).alias("export"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, route, CASE WHEN engine IS NOT NULL THEN engine <> string_split(route, ',')[1] END AS fallback, CASE engine WHEN 'gemini' THEN 'Gemini' WHEN 'sarvam' THEN 'Sarvam' WHEN 'stub' THEN 'No OCR' END || CASE WHEN engine <> 'stub' AND engine <> string_split(route, ',')[1] THEN ' (fallback)' ELSE '' END || CASE WHEN ms <= 0 THEN '' WHEN ms >= 10000 THEN ' · ' || floor(ms / 1000.0 + 0.5)::BIGINT || 's' WHEN ms % 500 = 250 THEN ' · ' || printf('%.1f', ms / 1000.0::DOUBLE + 0.01::DOUBLE) || 's' ELSE ' · ' || printf('%.1f', ms / 1000.0::DOUBLE) || 's' END AS tag FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'gemini,sarvam' WHEN 'N' THEN 'sarvam,gemini' ELSE 'gemini' END AS route, CASE l_linenumber % 4 WHEN 0 THEN 'gemini' WHEN 1 THEN 'sarvam' WHEN 2 THEN 'stub' END AS engine, (l_partkey * 50 % 12000)::BIGINT AS ms FROM lineitem)")
def engine_tags(spark, d):
    """Routes, fallback and labels of engines."""
    at = F.col("l_linenumber") % 4
    engine = F.when(at == 0, "gemini").when(at == 1, "sarvam").when(at == 2, "stub")
    profile = F.when(F.col("l_returnflag") == "A", "FAST").when(F.col("l_returnflag") == "N", "HEAVY")
    fell = states.is_fallback(engine, profile)
    tag = states.engine_tag(engine, fell, F.col("l_partkey") * 50 % 12000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(states.route(profile), ",").alias("route"), fell.alias("fallback"), tag.alias("tag"))


@query("SELECT event_id, round(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.35 * LEAST(1.0, user_id % 150 / 100.0) WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 0.35 + 0.62 * LEAST(1.0, user_id % 120 / 100.0) ELSE 0.35 + 0.62 * (1 - exp(-(user_id % 30) / 6.0)) END ELSE 0.0 END, 6)::DOUBLE AS share FROM events".replace("1.0 ", "1.0::DOUBLE ").replace("0.35 *", "0.35::DOUBLE *"))
def upload_shares(spark, d):
    """How far uploads are."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "uploading").when(F.col("event_type") == "view", "processing").otherwise("queued")
    user = F.col("user_id")
    share = states.upload_share(status, user % 150, F.when(user % 2 == 0, user % 120), user % 30)
    return table(spark, d, "events").select("event_id", F.round(share, 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, [800, 1200, 1800, 2700, 3000, 3000, 3000, 3000, 3000][l_linenumber + 1] AS gap, floor(LEAST(10000, 1000 * pow(2, GREATEST(0, l_linenumber - 1))) * (0.8::DOUBLE + (l_partkey % 8) / 8.0::DOUBLE * 0.4::DOUBLE) + 0.5)::INTEGER AS wait FROM lineitem")
def wait_schedule(spark, d):
    """Waits between polls and after failures."""
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", states.poll_gap(n).alias("gap"), states.retry_wait(n, F.col("l_partkey") % 8 / 8.0).alias("wait"))


@query("SELECT l_orderkey, ' · ' || n || CASE n WHEN 1 THEN ' page' ELSE ' pages' END || CASE WHEN r > 0 THEN ' · ' || r || ' to review' ELSE '' END AS summary FROM (SELECT l_orderkey, COUNT(*) AS n, COUNT(*) FILTER (l_quantity > 40) AS r FROM lineitem GROUP BY 1)")
def upload_summaries(spark, d):
    """Pages of uploads and those to review."""
    counted = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 40).alias("r"))
    return counted.select("l_orderkey", states.page_summary(F.col("n"), F.col("r")).alias("summary"))


@query(f"WITH {JOBS}, u AS (SELECT c_custkey AS upload_id, CASE WHEN c_custkey % 2 = 1 THEN md5(c_custkey::VARCHAR) END AS sha256, 'scan ' || c_custkey || '.pdf' AS filename, CASE c_custkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'light' END AS mode, TIMESTAMP '1995-06-17 00:00:10' AS started_at FROM customer) SELECT upload_id, (SELECT arg_max(job_id, (created_at, job_id)) FROM jobs j WHERE (CASE WHEN u.sha256 IS NOT NULL THEN j.sha256 = u.sha256 ELSE j.filename = u.filename END) AND j.created_at >= u.started_at - INTERVAL 15 SECONDS AND (u.mode IS NULL OR j.mode = u.mode)) AS job_id FROM u")
def lost_reply_lookup(spark, d):
    """The jobs that uploads without a reply became."""
    key = F.col("c_custkey")
    uploads = table(spark, d, "customer").select(
        key.alias("upload_id"),
        F.when(key % 2 == 1, F.md5(key.cast("string"))).alias("sha256"),
        F.concat(F.lit("scan "), key.cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(key % 3 == 0, "auto").when(key % 3 == 1, "light").alias("mode"),
        F.lit("1995-06-17 00:00:10").cast("timestamp_ntz").alias("started_at"),
    )
    return states.lost_replies(uploads, job_table(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))).select("upload_id", "job_id")


@query("SELECT l_orderkey AS page, CASE WHEN bool_and(COALESCE(e = 'stub', false)) THEN 'stub' ELSE COALESCE(arg_min(e, (l_linenumber, e)) FILTER (e NOT IN ('stub', 'gemini')), arg_min(e, (l_linenumber, e)) FILTER (e <> 'stub')) END AS engine FROM (SELECT *, CASE l_suppkey % 6 WHEN 0 THEN 'gemini' WHEN 1 THEN 'sarvam' WHEN 2 THEN NULL ELSE 'stub' END AS e FROM lineitem) GROUP BY 1")
def page_engines(spark, d):
    """The engine of pages that were read in bands."""
    at = F.col("l_suppkey") % 6
    engine = F.when(at == 0, "gemini").when(at == 1, "sarvam").when(at > 2, "stub")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("band"), engine.alias("engine"))
    return states.page_engines(rows, "gemini")


CALLS = "calls AS (SELECT l_orderkey AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS attempt, CASE l_partkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE CASE WHEN l_suppkey % 2 = 0 THEN 500 ELSE 404 END END::INTEGER AS status, l_quantity / 10.0 AS asked FROM lineitem)"


@query(f"WITH {CALLS}, e AS (SELECT *, (status IS NULL OR status IN (429, 503)) AS again, attempt * 4 + GREATEST(pow(2.0, attempt), asked) > 30 AS late FROM calls WHERE attempt <= 5), f AS (SELECT DISTINCT ON (call_id) * FROM e WHERE NOT again OR attempt = 5 OR late ORDER BY call_id, attempt) SELECT call_id, attempt AS attempts, status, COALESCE(status < 400, false) AS ok, COALESCE(status >= 500, true) OR (again AND late AND attempt < 5) AS outage FROM f")
def retry_outcomes(spark, d):
    """What callers get from a log of answers, under the limit of tries and the deadline."""
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem")
    part = F.col("l_partkey") % 5
    status = F.when(part == 0, 200).when(part == 1, 429).when(part == 2, 503).when(part == 4, F.when(F.col("l_suppkey") % 2 == 0, 500).otherwise(404))
    attempt = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    calls = rows.select(F.col("l_orderkey").alias("call_id"), attempt.alias("attempt"), status.alias("status"), (F.col("l_quantity") / 10.0).cast("string").alias("retry_after"))
    return states.with_retries(calls.withColumn("at", F.col("attempt") * 4), 30)


_C, _V = "ksh|ch|dh|ng|sh|th|zh|L|N|R|S|b|c|d|g|h|j|k|l|m|n|p|r|s|t|v|w|y", "aa|ae|ai|au|ee|oe|oo|A|E|I|O|U|a|e|i|o|u"
_CONSONANTS = ", ".join(f"('{a}', '{b}')" for a, b in script.CONSONANTS.items())
_VOWELS = ", ".join(f"('{a}', '{b}', '{c}')" for a, (b, c) in script.VOWELS.items())


@query(
    f"WITH c(cr, letter) AS (VALUES {_CONSONANTS}), v(vr, alone, sign) AS (VALUES {_VOWELS}), t AS (SELECT p_partkey, regexp_extract_all(p_name || ' man q', '(?:{_C})(?:{_V})?|(?:{_V})|(?s:.)') AS x FROM part), "
    f"e AS (SELECT p_partkey, k, x[k] AS s, x[k + 1] AS following, regexp_extract(x[k], '^(?:{_C})') AS cr FROM (SELECT p_partkey, x, UNNEST(range(1, len(x) + 1)) AS k FROM t)), "
    "o AS (SELECT p_partkey, k, CASE WHEN s = 'q' THEN 'ஃ' WHEN s = 'n' AND NOT COALESCE(regexp_matches(following, '^[A-Za-z]'), false) THEN 'ன்' WHEN cr <> '' AND s = cr THEN letter || '்' WHEN cr <> '' THEN letter || sign ELSE COALESCE(alone, s) END AS y "
    "FROM e LEFT JOIN c USING (cr) LEFT JOIN v ON v.vr = substr(s, length(e.cr) + 1)) SELECT p_partkey, string_agg(y, '' ORDER BY k) AS tamil FROM o GROUP BY p_partkey"
)
def transliterated(spark, d):
    """Names in Tamil letters."""
    return table(spark, d, "part").select("p_partkey", script.transliterate(F.concat("p_name", F.lit(" man q"))).alias("tamil"))


@query(f"WITH {LINES}, f AS (SELECT *, position('the' IN lower(body)) AS k FROM lines) SELECT doc_id, page, seq, substr(body, 1, k - 1) || '<mark>' || substr(body, k, 3) || '</mark>' || substr(body, k + 3) AS snippet FROM f WHERE k > 0")
def substring_highlights(spark, d):
    """Lines that hold a text, marked, whatever the case."""
    return lines(spark, d).select("doc_id", "page", "seq", script.highlight(F.col("body"), " The").alias("snippet")).where("snippet is not null")


@query("SELECT conv_id, turn, text, '0-' || length(a) || ' ' || (length(a) + length(b) + 2) || '-' || length(text) AS ranges FROM (SELECT conv_id, turn, text, string_split(text, ' ') AS x, x[1] AS a, x[2] AS b FROM conversations) WHERE len(x) > 2 AND length(a) > 0")
def highlight_ranges(spark, d):
    """Marked ranges of snippets; the last mark isn't closed."""
    words = F.split("text", " ")
    raw = F.concat(F.lit("<mark>"), F.get(words, 0), F.lit("</mark> "), F.get(words, 1), F.lit(" <mark>"), F.array_join(F.slice(words, 3, 1 << 20), " "))
    found = table(spark, d, "conversations").where((F.size(words) > 2) & (F.get(words, 0) != "")).select("conv_id", "turn", script.ranges(raw).alias("r"))
    return found.select("conv_id", "turn", "r.text", F.array_join(F.transform("r.ranges", lambda x: F.concat_ws("-", x.cast("array<string>"))), " ").alias("ranges"))


@query("SELECT p_partkey, p_type AS reading, p_type || '|-' || p_type AS candidates FROM part")
def simple_readings(spark, d):
    """A word without marks at its ends, and made-up candidates."""
    word = F.concat(F.lit("-"), "p_type", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", script.trimmed_reading(word, X.LATIN).alias("reading"), F.array_join(script.plain_candidates(word, X.LATIN), "|").alias("candidates"))


@query(f"WITH {LINES}, s AS (SELECT doc_id, page, seq, body, len(regexp_extract_all(body, '[A-Za-z\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}]'))::DOUBLE / NULLIF(len(regexp_extract_all(body, '\\p{{L}}')), 0) AS share, len(regexp_extract_all(body, '[^{_LATIN}\\p{{Nd}} .,;:\\-!?''\"()\\[\\]\\x{{2014}}\\x{{2013}}]')) AS odd FROM lines) SELECT doc_id, page, seq, CASE WHEN share IS NULL THEN CASE WHEN regexp_matches(body, '\\p{{Nd}}') THEN 0.3 ELSE 0.0 END WHEN share < 0.5 THEN round(share * 0.6, 2) WHEN odd = 0 AND share >= 0.9 THEN 0.99 ELSE round(LEAST(GREATEST(0.62::DOUBLE, 0.9::DOUBLE - 0.07::DOUBLE * GREATEST(0, odd - 1)), CASE WHEN share < 0.9 THEN 0.54 ELSE 1.0 END), 2) END::DOUBLE AS score FROM s")
def demo_scores(spark, d):
    """The demonstration's line score."""
    return lines(spark, d).select("doc_id", "page", "seq", script.demo_score(F.col("body"), X.LATIN).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'hsla(' || floor(CASE WHEN l_quantity / 64 <= 0.5 THEN 130 - 200 * (l_quantity / 64) ELSE 60 - 60 * (l_quantity / 64) END + 0.5)::BIGINT || ', 85%, 45%, 0.35)' AS colour FROM lineitem")
def heat_colours(spark, d):
    """Colours of damage."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", drawing.heat_colour(F.col("l_quantity") / 64, 0.35).alias("colour"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(w, 6) AS w, round(h, 6) AS h, round(CASE WHEN 900 < w THEN (900 - w) / 2 ELSE GREATEST(0, LEAST(x - w / 2, 900 - w)) END, 6) AS x, round(CASE WHEN 700 < h THEN (700 - h) / 2 ELSE GREATEST(0, LEAST(y - h / 2, 700 - h)) END, 6) AS y FROM (SELECT *, CASE WHEN tall * 4 < ww * 1.15 THEN ww * 1.15 ELSE tall * 4 END AS w, CASE WHEN tall * 4 < ww * 1.15 THEN ww * 1.15 / 4 ELSE tall END AS h FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 900)::DOUBLE + (l_suppkey % 400) / 2.0::DOUBLE AS x, (l_suppkey % 700)::DOUBLE + l_quantity::DOUBLE / 2 AS y, (l_suppkey % 400)::DOUBLE AS ww, GREATEST(l_quantity::DOUBLE, 20) * (1 + 2 * 0.35::DOUBLE) AS tall FROM lineitem))")
def word_crops(spark, d):
    """Crops round words."""
    box = drawing.word_crop(F.col("l_suppkey") % 700, F.col("l_quantity").cast("double"), F.col("l_partkey") % 900, F.col("l_suppkey") % 400, F.lit(20), F.lit(900.0), F.lit(700.0), 4.0, 0.35)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(box[c], 6).alias(c) for c in "xywh"])


@query(f"WITH {JOBS} SELECT job_id, filename, status FROM jobs WHERE job_id = 7")
def job_lookup(spark, d):
    """One job by its id."""
    return jobs.by_id(job_table(spark, d), 7).select("job_id", "filename", "status")


@query("WITH m AS (SELECT sha256(text) AS sha256, doc_id, strlen(text) AS n FROM documents) SELECT sha256, MIN('master-' || lpad(doc_id::VARCHAR, 9, '0')) AS path, MIN(n)::BIGINT AS length, 'pending' AS status FROM m WHERE sha256 NOT IN (SELECT sha256 FROM m WHERE doc_id % 3 = 0) GROUP BY sha256")
def master_manifest(spark, d):
    """K1, K2: files whose bytes aren't stored yet, and the pending jobs they make."""
    docs = table(spark, d, "documents")
    stored = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"))
    files = docs.select(F.concat(F.lit("master-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").cast("binary").alias("content"))
    return tables.submitted(tables.new_masters(stored, files)).select("sha256", "path", "length", "status")


@query("WITH b AS (SELECT l_orderkey AS page_num, l_partkey % 50 AS x, arg_max(l_discount, (l_linenumber, l_partkey, l_suppkey)) AS confidence FROM lineitem GROUP BY ALL) SELECT l_orderkey AS page_num, l_linenumber, l_partkey, b.confidence FROM lineitem l LEFT JOIN b ON b.page_num = l.l_orderkey AND b.x = l.l_suppkey % 50")
def box_confidence(spark, d):
    """Confidence of blocks by their coordinates."""
    rows = table(spark, d, "lineitem")
    box = lambda c: F.struct((F.col(c) % 50).alias("x1"), F.lit(0).alias("y1"))
    blocks = rows.select(F.col("l_orderkey").alias("page_num"), box("l_partkey").alias("coordinates"), F.col("l_linenumber").alias("reading_order"), F.struct("l_partkey", "l_suppkey").alias("block_id"), F.col("l_discount").alias("confidence"))
    own = rows.select(F.col("l_orderkey").alias("page_num"), "l_linenumber", "l_partkey", box("l_suppkey").alias("coordinates"))
    return layout.block_confidence(own, blocks).select("page_num", "l_linenumber", "l_partkey", "confidence")
