"""Review queues, suggestions, receipts, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .pages import page_review

MOST_CANDIDATES, MOST_SHOWN, LONGEST = 3, 9, 256


def queue(lines: DataFrame, mode: str = "auto") -> DataFrame:
    """What a reviewer sees: doubtful lines, with ``review`` also those that are merely ok."""
    return lines.withColumn("band", X.band(F.col("confidence"))).where(F.col("band").isin(*(["doubt"] if mode == "auto" else ["doubt", "ok"])))


def routing(lines: DataFrame) -> DataFrame:
    """Per document: lines, those routed to people, those accepted."""
    band = X.band(F.col("confidence"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(band == "doubt").alias("routed"), F.count_if(band != "doubt").alias("accepted"))


def candidates(raw: Column, before: Column, script: X.Script, most: int = MOST_CANDIDATES) -> Column:
    """``raw`` (array of text, score) cleaned: trimmed, distinct, not ``before``, of at most three words with a letter of the script; scores in 0..1, missing ones a half; best first, ties as given."""
    held = F.transform(raw, lambda x, i: F.struct(X.strip(x.text).alias("text"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.score, F.lit(0.5)), F.lit(0.5)))), 3).alias("score"), i.alias("at")))
    good = F.filter(held, lambda x: (x.text != "") & (F.length(x.text) <= LONGEST) & (F.size(X.words(x.text)) <= 3) & (x.text != X.strip(before)) & X.has_script_letter(x.text, script))
    first = F.filter(good, lambda x, i: ~F.exists(F.slice(good, 1, i), lambda y: y.text == x.text))
    ranked = F.slice(F.array_sort(F.transform(first, lambda x: F.struct((-x.score).alias("k"), x.at, x.text, x.score))), 1, most)
    return F.transform(ranked, lambda x: F.struct(x.text.alias("text"), x.score.alias("score")))


def shown(suggestions: Column, most: int = MOST_SHOWN) -> Column:
    """Suggestions in the editor's order: by score, those without one last."""
    ranked = F.array_sort(F.transform(suggestions, lambda x, i: F.struct((-F.coalesce(x.score, F.lit(-1.0))).alias("k"), i.alias("at"), x.text, x.score)))
    return F.slice(F.transform(ranked, lambda x: F.struct(x.text.alias("text"), x.score.alias("score"))), 1, most)


def context(rows: DataFrame, key: str, order: str, text: str, reach: int = 2) -> DataFrame:
    """``rows`` with the texts of up to ``reach`` neighbours on each side."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.collect_list(text).over(w.rowsBetween(-reach, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, reach)))


def receipt(lines: DataFrame) -> DataFrame:
    """Per document: pages and lines, automatic and for people; corrections that count, pages with stubs, milliseconds. ``lines`` has needs_review and applied, and may have its page's profile and processing_ms."""
    has = lambda c: c in lines.columns
    pages = lines.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("needs_review").alias("human"),
        F.sum(F.size("applied")).alias("corrections"),
        page_review(F.max("profile") if has("profile") else F.lit("FAST"), F.max("confidence")).alias("review"),
        F.max(X.is_stub(F.col("body"))).alias("stub"),
        (F.max("processing_ms") if has("processing_ms") else F.lit(0)).alias("ms"),
    )
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("review").alias("pages_human"),
        F.count_if(~F.col("review")).alias("pages_auto"),
        F.sum("n").alias("lines"),
        F.sum("human").alias("lines_human"),
        F.sum(F.col("n") - F.col("human")).alias("lines_auto"),
        F.sum("corrections").alias("corrections"),
        F.count_if("stub").alias("stub_pages"),
        F.sum(F.coalesce("ms", F.lit(0))).cast("long").alias("processing_ms"),
    )


def receipt_text(receipts: DataFrame) -> DataFrame:
    return receipts.withColumn("text", F.format_string("pages %d (auto %d, review %d); lines %d (auto %d, review %d); corrections %d", *[F.col(c) for c in ("pages", "pages_auto", "pages_human", "lines", "lines_auto", "lines_human", "corrections")]))


def tiers(corrections: DataFrame, key: str, tier: str) -> DataFrame:
    """Per key the number of corrections of each tier, as a map."""
    each = corrections.groupBy(key, tier).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tier, "n")))).alias("tiers"))


def next_page(pending: DataFrame, current: Column) -> Column:
    """The next page with work after ``current``, else the first: an aggregate over ``page``."""
    return F.coalesce(F.min(F.when(F.col("page") > current, F.col("page"))), F.min("page"))
