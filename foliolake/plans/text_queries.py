"""Queries over lines of documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udfs import nfc
from ..operators import export, filtering, overlay, pages, review, search
from .fragments import BLANKS, CORRECTIONS, LINES, SCORED, SIGNALS, WORDS, corrections, index, lines, scored, strip_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {SCORED} SELECT doc_id, page, seq, confidence, needs_review FROM reviewed")
def line_quality(spark, d):
    """The score of every line and whether a person must see it."""
    return scored(spark, d).select("doc_id", "page", "seq", "confidence", "needs_review")


@query(f"WITH {SIGNALS} SELECT doc_id, page, seq, round(share, 6) AS share, odd::INTEGER AS odd, repeated::INTEGER AS repeated, loop, visible::INTEGER AS visible FROM signals")
def line_signals(spark, d):
    """The signals behind the score."""
    s = lines(spark, d).withColumn("s", X.signals(F.col("body"), X.LATIN))
    return s.select("doc_id", "page", "seq", F.round("s.share", 6).alias("share"), "s.odd", "s.repeated", "s.loop", "s.visible")


@query(f"WITH {SCORED}, p AS (SELECT doc_id, page, COUNT(*) AS n, COUNT(*) FILTER (needs_review) AS r, MAX(confidence) < 0.5 AS review FROM reviewed GROUP BY ALL) SELECT doc_id, COUNT(*) AS page_count, COUNT(*) FILTER (review) AS pages_needing_review, SUM(n)::BIGINT AS n_lines, SUM(r)::BIGINT AS lines_needing_review FROM p GROUP BY doc_id")
def doc_review_summary(spark, d):
    """A4: per-document counts."""
    return pages.document_summaries(scored(spark, d))


@query(f"WITH {SCORED} SELECT doc_id, page, COUNT(*) AS n_lines, COUNT(*) FILTER (needs_review) AS n_review, MAX(confidence) AS best, round(AVG(confidence), 6) AS mean_confidence, bool_or(page % 3 = 0) OR MAX(confidence) < 0.5 AS needs_review FROM reviewed GROUP BY ALL")
def pages_needing_review(spark, d):
    """Per-page counts and the page flag; every third page is of the HEAVY profile."""
    return pages.page_summaries(scored(spark, d).withColumn("profile", F.when(F.col("page") % 3 == 0, "HEAVY").otherwise("FAST")))


@query(f"WITH {SCORED} SELECT doc_id, page, string_agg(body, chr(10) ORDER BY seq) AS text, COUNT(*)::INTEGER AS n, MAX(confidence) < 0.5 AS needs_review, string_agg('L' || seq, ' ' ORDER BY seq) AS ids FROM reviewed GROUP BY ALL")
def page_results(spark, d):
    """Pages built from lines."""
    built = pages.build_pages(scored(spark, d))
    return built.select("doc_id", "page", "text", F.size("lines").alias("n"), "needs_review", F.array_join(F.transform("lines", lambda x: x.id), " ").alias("ids"))


@query(f"WITH {SCORED} SELECT CASE WHEN confidence >= 0.95 THEN 'auto' WHEN confidence >= 0.8 THEN 'ok' ELSE 'doubt' END AS band, COUNT(*) AS n, MIN(confidence) AS low, MAX(confidence) AS high FROM scored GROUP BY 1")
def confidence_bands(spark, d):
    """Lines by band with the range of confidence."""
    return scored(spark, d).groupBy(X.band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


@query(f"WITH {SCORED} SELECT doc_id, page, seq, CASE WHEN confidence >= 0.8 THEN 'ok' ELSE 'doubt' END AS band FROM scored WHERE confidence < 0.95")
def review_queue(spark, d):
    """V2: the queue in review mode."""
    return review.queue(scored(spark, d), "review").select("doc_id", "page", "seq", "band")


@query(f"WITH {SCORED} SELECT doc_id, COUNT(*) AS total, COUNT(*) FILTER (confidence < 0.8) AS routed, COUNT(*) FILTER (confidence >= 0.8) AS accepted FROM scored GROUP BY doc_id")
def routing_summary(spark, d):
    """Lines routed and accepted."""
    return review.routing(scored(spark, d))


@query(f"WITH {SCORED}, x AS (SELECT s.*, d.lang, g.share, g.odd, g.visible, g.loop FROM scored s JOIN signals g USING (doc_id, page, seq) JOIN documents d USING (doc_id)) SELECT lang, COUNT(*) AS n_lines, round(AVG(share), 6) AS script_ratio, round(AVG(CASE WHEN odd / GREATEST(visible, 1) > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS garbage_rate, COUNT(*) FILTER (loop) AS loop_lines, round(AVG(confidence), 6) AS mean_confidence FROM x GROUP BY lang")
def corpus_metrics(spark, d):
    """Script ratio, garbage rate, loops and mean confidence by language."""
    own = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("body")).withColumn("s", X.signals(F.col("body"), X.LATIN))
    return own.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.avg("s.share"), 6).alias("script_ratio"),
        F.round(F.avg(F.when(F.col("s.odd") / F.greatest("s.visible", F.lit(1)) > 0.2, 1.0).otherwise(0.0)), 6).alias("garbage_rate"),
        F.count_if("s.loop").alias("loop_lines"),
        F.round(F.avg(X.line_score(F.col("body"), X.LATIN)), 6).alias("mean_confidence"),
    )


@query(f"WITH {SIGNALS} SELECT doc_id, page, seq, body FROM signals WHERE loop")
def repeat_loop_lines(spark, d):
    """Lines in which one word is most."""
    return lines(spark, d).where(X.repetition_loop(F.col("body")))


FILTER = SIGNALS + rf""",
own AS (SELECT doc_id, page, seq, body, COALESCE(share, 0) < 0.5 AS dropped FROM signals WHERE visible > 0),
raw AS (SELECT doc_id, page, seq, regexp_extract_all(body, '[^.!?\x{{0964}}\x{{0965}}]+[.!?\x{{0964}}\x{{0965}}]*') AS x FROM own WHERE NOT dropped),
each AS (SELECT doc_id, page, seq, UNNEST(x) AS sentence, generate_subscripts(x, 1) AS pos FROM raw),
keyed AS (SELECT *, {strip_sql("sentence")} AS key FROM each),
sents AS (SELECT *, key <> '' AND row_number() OVER (PARTITION BY doc_id, key ORDER BY page, seq, pos) > 1 AS again FROM keyed),
kept AS (SELECT doc_id, page, seq, string_agg(sentence, '' ORDER BY pos) AS body FROM sents WHERE NOT again GROUP BY ALL),
clean AS (SELECT * FROM kept WHERE regexp_matches(body, '[^{BLANKS}]'))"""


@query(f"WITH {FILTER} SELECT * FROM clean")
def text_filter_keep(spark, d):
    """Lines of the script with sentences once per document."""
    return filtering.clean(filtering.own_script(lines(spark, d), X.LATIN), ["page", "seq"])


@query(f"WITH {FILTER} SELECT o.doc_id, COUNT(*) FILTER (dropped) AS dropped, COALESCE((SELECT COUNT(*) FROM sents s WHERE s.doc_id = o.doc_id AND again), 0) AS repeats, COALESCE((SELECT COUNT(*) FROM clean c WHERE c.doc_id = o.doc_id), 0) AS kept FROM own o GROUP BY o.doc_id")
def text_filter_totals(spark, d):
    """What the filter dropped, removed and kept."""
    return filtering.totals(filtering.own_script(lines(spark, d), X.LATIN), ["page", "seq"])


@query(f"WITH {FILTER} SELECT doc_id, page, seq, pos::INTEGER - 1 AS pos, key FROM sents WHERE NOT again AND key <> ''")
def sentence_first_occurrence(spark, d):
    """The first place of each sentence of a document."""
    return filtering.sentences(filtering.own_script(lines(spark, d), X.LATIN), ["page", "seq"]).where("not again and key <> ''").select("doc_id", "page", "seq", F.col("at").alias("pos"), "key")


@query(f"WITH {SCORED} SELECT doc_id, page, seq, CASE WHEN confidence < 0.5 THEN 'REVIEW' WHEN confidence < 0.8 THEN 'FLAG' ELSE 'KEEP' END AS label FROM scored")
def filter_route(spark, d):
    """The filter's label of every line."""
    return scored(spark, d).select("doc_id", "page", "seq", X.route(F.col("confidence")).alias("label"))


@query(f"WITH {CORRECTIONS} SELECT doc_id, page, seq, final_body, counts::INTEGER AS applied FROM final")
def apply_corrections(spark, d):
    """The overlay, with the number of corrections that count on each line."""
    return overlay.apply(lines(spark, d), corrections(spark, d)).select("doc_id", "page", "seq", "final_body", F.size("applied").alias("applied"))


@query(f"WITH {CORRECTIONS} SELECT doc_id, COUNT(*) FILTER (counts) AS applied FROM final GROUP BY doc_id")
def applicable_corrections_count(spark, d):
    """A5: corrections that count, by document."""
    return overlay.apply(lines(spark, d), corrections(spark, d)).groupBy("doc_id").agg(F.sum(F.size("applied")).alias("applied"))


@query(f"WITH {CORRECTIONS} SELECT doc_id, page, string_agg(final_body, chr(10) ORDER BY seq) AS text FROM final GROUP BY ALL")
def final_text(spark, d):
    """Final texts of pages."""
    return overlay.final_texts(overlay.apply(lines(spark, d), corrections(spark, d)))


@query(f"WITH {CORRECTIONS} SELECT doc_id, page, seq, word, before, after, 'human' AS tier FROM final WHERE counts")
def applied_corrections(spark, d):
    """The corrections that count, as the page carries them."""
    done = overlay.apply(lines(spark, d), corrections(spark, d))
    return done.select("doc_id", "page", "seq", F.explode("applied").alias("c")).select("doc_id", "page", "seq", "c.*", F.lit("human").alias("tier"))


@query(f"WITH {CORRECTIONS} SELECT DISTINCT before, CASE WHEN length(before) = 6 THEN before ELSE after END AS after FROM corrections WHERE pos = 2 EXCEPT SELECT before, after FROM corrections WHERE pos = 1")
def learned_pair_diff(spark, d):
    """Pairs of the second save that the first lacks; words of six letters are confirmed as they are."""
    every = corrections(spark, d)
    saved = every.where("pos = 2").withColumn("after", F.when(F.length("before") == 6, F.col("before")).otherwise(F.col("after")))
    return overlay.learned(saved, every.where("pos = 1"))


@query(f"WITH {CORRECTIONS}, l AS (SELECT * FROM latest), n AS (SELECT doc_id, page, seq, word, before, 'x' AS after FROM l WHERE page = 1) SELECT doc_id, page, seq, word, before, after FROM l WHERE (doc_id, page) NOT IN (SELECT doc_id, page FROM n) UNION ALL SELECT * FROM n")
def corrections_payload(spark, d):
    """The saved map after an edit of first pages."""
    old = overlay.latest(corrections(spark, d))
    return overlay.merge(old, old.where("page = 1").withColumn("after", F.lit("x")))


@query(f"WITH {CORRECTIONS} SELECT doc_id, page, seq, word, before, after FROM latest WHERE page <> 2")
def corrections_without_page(spark, d):
    """K5: corrections after a page has been read again."""
    return overlay.drop_page(overlay.latest(corrections(spark, d)), 2)


@query(f"WITH {CORRECTIONS}, s AS (SELECT r.doc_id, r.page, r.confidence, r.needs_review, r.body FROM ({{reviewed}}) r), c AS (SELECT doc_id, page, COUNT(*) FILTER (counts) AS c FROM final GROUP BY ALL), p AS (SELECT doc_id, page, COUNT(*) AS n, COUNT(*) FILTER (needs_review) AS h, MAX(confidence) < 0.5 AS review, bool_or(starts_with(body, '[stub]')) AS stub FROM s GROUP BY ALL) SELECT doc_id, COUNT(*) AS pages, COUNT(*) FILTER (review) AS pages_human, COUNT(*) FILTER (NOT review) AS pages_auto, SUM(n)::BIGINT AS lines, SUM(h)::BIGINT AS lines_human, SUM(n - h)::BIGINT AS lines_auto, SUM(c)::BIGINT AS corrections, COUNT(*) FILTER (stub) AS stub_pages, SUM(10 * page)::BIGINT AS processing_ms FROM p JOIN c USING (doc_id, page) GROUP BY doc_id".replace("{reviewed}", f"WITH {SCORED} SELECT * FROM reviewed"))
def receipt_totals(spark, d):
    """Receipts."""
    return review.receipt(overlay.apply(scored(spark, d), corrections(spark, d)).withColumn("processing_ms", 10 * F.col("page")))


@query(ORACLES["receipt_totals"].replace("SELECT doc_id, COUNT(*) AS pages", "SELECT doc_id, printf('pages %d (auto %d, review %d); lines %d (auto %d, review %d); corrections %d', COUNT(*), COUNT(*) FILTER (NOT review), COUNT(*) FILTER (review), SUM(n)::BIGINT, SUM(n - h)::BIGINT, SUM(h)::BIGINT, SUM(c)::BIGINT) AS text FROM p JOIN c USING (doc_id, page) GROUP BY doc_id --"))
def receipt_lines(spark, d):
    """Receipts as text."""
    return review.receipt_text(receipt_totals(spark, d)).select("doc_id", "text")


TOKENS = CORRECTIONS + rf""",
idx AS (SELECT doc_id, page, seq, {strip_sql("final_body")} AS body, regexp_extract_all(strip_accents(lower({strip_sql("final_body")})), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS tokens FROM final),
index AS (SELECT * FROM idx WHERE body <> '')"""


@query(f"WITH {TOKENS}, t AS (SELECT doc_id, page, seq, UNNEST(tokens) AS term FROM index) SELECT term, COUNT(*) AS occurrences, COUNT(DISTINCT (doc_id, page, seq)) AS n_lines FROM t GROUP BY term")
def postings_terms(spark, d):
    """terms with their lines and occurrences."""
    return search.terms(index(spark, d))


PHRASES = ("the", "of-the")
RANKED = TOKENS + """,
f AS (SELECT *, len(tokens) AS length, len(list_filter(tokens, lambda x: x = 'the')) AS f0,
        len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the')) AS f1 FROM index),
n AS (SELECT COUNT(*) AS n, AVG(length) AS mean, COUNT(*) FILTER (f0 > 0) AS d0, COUNT(*) FILTER (f1 > 0) AS d1 FROM f),
r AS (SELECT doc_id, page, seq, body, round(0.0 - GREATEST(1e-6, ln((n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (1 - 0.75 + 0.75 * length / mean))
                                      - GREATEST(1e-6, ln((n - d1 + 0.5) / (d1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (1 - 0.75 + 0.75 * length / mean)), 4) AS score FROM f, n WHERE f0 > 0 AND f1 > 0)"""


@query(f"WITH {RANKED} SELECT doc_id, page, seq, score, body FROM r ORDER BY score, doc_id, page, seq LIMIT 20")
def search_bm25_topk(spark, d):
    """The best lines for a word and a phrase."""
    return search.search(index(spark, d), " ".join(PHRASES))


@query(f"WITH {RANKED} SELECT COUNT(*) AS total FROM r")
def search_count(spark, d):
    """A2: matches of the query."""
    return search.matches(index(spark, d), " ".join(PHRASES)).agg(F.count(F.lit(1)).alias("total"))


@query(f"WITH {RANKED} SELECT r.doc_id, page, seq, score, source, lang FROM r JOIN documents USING (doc_id)")
def search_join_jobs(spark, d):
    """Ranked hits with their documents."""
    hits = search.ranked(index(spark, d), " ".join(PHRASES)).select("doc_id", "page", "seq", "score")
    return hits.join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")


@query()
def search_snippets(spark, d):
    """the best lines with marked snippets."""
    query = " ".join(PHRASES)
    return search.with_snippets(search.search(index(spark, d), query), query).select("doc_id", "page", "seq", "snippet")


@query(f"WITH {LINES}, w AS (SELECT doc_id, page, seq, {WORDS} AS x FROM lines) SELECT doc_id, page, seq, UNNEST(x) AS word, generate_subscripts(x, 1)::INTEGER AS place FROM w")
def page_words(spark, d):
    """Words by place."""
    return lines(spark, d).select("doc_id", "page", "seq", F.posexplode(X.words(F.col("body"))).alias("k", "word")).select("doc_id", "page", "seq", "word", (F.col("k") + 1).alias("place"))


@query(f"WITH {SCORED} SELECT doc_id, page, seq, concat_ws(',', page, 'L' || seq, seq, CASE WHEN regexp_matches(body, '[\",\\r\\n]') THEN '\"' || replace(body, '\"', '\"\"') || '\"' ELSE body END, printf('%.4f', confidence)) AS row FROM scored")
def csv_export_rows(spark, d):
    """CSV rows of lines: page, line id, place, text, confidence."""
    own = scored(spark, d).withColumn("shown", F.format_string("%.4f", "confidence")).withColumn("id", F.concat(F.lit("L"), F.col("seq").cast("string")))
    return export.csv_rows(own, ["page", "id", "seq", "body", "shown"]).select("doc_id", "page", "seq", "row")


TXT = LINES + """,
p AS (SELECT doc_id, page, string_agg(body, chr(10) ORDER BY seq) FILTER (NOT starts_with(body, '[stub]')) AS t, COUNT(*) OVER (PARTITION BY doc_id) AS n FROM lines GROUP BY doc_id, page),
j AS (SELECT doc_id, regexp_replace(string_agg(CASE WHEN n > 1 THEN chr(10) || '=== page ' || page || ' ===' || chr(10) ELSE '' END || COALESCE(t, ''), chr(10) ORDER BY page), '^\\n+', '') AS text FROM p GROUP BY doc_id)"""


@query(f"WITH {TXT} SELECT doc_id, CASE WHEN text = '' THEN '' ELSE text || chr(10) END AS text FROM j")
def txt_export(spark, d):
    """Plain text of documents."""
    return export.txt(pages.build_pages(lines(spark, d).withColumn("confidence", F.lit(1.0)).withColumn("needs_review", F.lit(False))))


@query(f"WITH {LINES}, e AS (SELECT doc_id, page, seq, regexp_replace(body, '([\\\\`*_{{}}\\[\\]()#+\\-.!|<>])', '\\\\\\1', 'g') AS body FROM lines WHERE NOT starts_with(body, '[stub]')), p AS (SELECT doc_id, page, '## Page ' || page || chr(10) || chr(10) || string_agg(body, '  ' || chr(10) ORDER BY seq) AS t FROM e GROUP BY doc_id, page) SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page) || chr(10) AS text FROM p GROUP BY doc_id")
def markdown_export(spark, d):
    """Markdown of documents."""
    return export.markdown(pages.build_pages(lines(spark, d).withColumn("confidence", F.lit(1.0)).withColumn("needs_review", F.lit(False))))


@query(f"WITH {SCORED}, l AS (SELECT doc_id, page, string_agg('    <line seq=\"' || seq || '\" confidence=\"' || printf('%.4f', confidence) || '\">' || replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</line>' || chr(10), '' ORDER BY seq) AS t FROM scored GROUP BY doc_id, page) SELECT doc_id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<document>' || chr(10) || string_agg('  <page number=\"' || page || '\">' || chr(10) || t || '  </page>' || chr(10), '' ORDER BY page) || '</document>' || chr(10) AS text FROM l GROUP BY doc_id")
def xml_export(spark, d):
    """XML of documents."""
    return export.xml(pages.build_pages(scored(spark, d)))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_texts(spark, d):
    """X11: texts in composed form."""
    return table(spark, d, "documents").select("doc_id", nfc("text").alias("text"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT a.conv_id, a.turn, COALESCE((SELECT string_agg(b.text, ' | ' ORDER BY b.k) FROM c b WHERE b.conv_id = a.conv_id AND b.k BETWEEN a.k - 2 AND a.k - 1), '') AS before, COALESCE((SELECT string_agg(b.text, ' | ' ORDER BY b.k) FROM c b WHERE b.conv_id = a.conv_id AND b.k BETWEEN a.k + 1 AND a.k + 2), '') AS after FROM c a")
def neighbour_context(spark, d):
    """Two neighbours on each side."""
    found = review.context(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", "turn", F.array_join("before", " | ").alias("before"), F.array_join("after", " | ").alias("after"))
