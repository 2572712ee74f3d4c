"""Reviewers' corrections laid over lines by position, with a guard against stale ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

KEY = ("doc_id", "page", "seq")


def latest(corrections: DataFrame) -> DataFrame:
    """One correction per word place: the last of those saved (``pos``)."""
    return corrections.groupBy(*KEY, "word").agg(F.max_by(F.struct("before", "after"), "pos").alias("c")).select(*KEY, "word", "c.*")


def apply(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """``lines`` with final_body and applied (struct array word, before, after).

    A correction counts if its word place exists and holds ``before`` (null: any word). A line without one
    keeps its body to the letter; others are their words joined by single blanks. One join per line, no
    row per word: a line's corrections travel as one list, in which the last saved of each word holds; they are shuffled once, by line.
    """
    saved = F.array_sort(F.collect_list(F.struct("word", "pos", "before", "after")))
    last = F.filter("_own", lambda c, i: (i == F.size("_own") - 1) | (F.get("_own", i + 1).word != c.word))
    by_line = corrections.groupBy(*KEY).agg(saved.alias("_own")).select(*KEY, F.transform(last, lambda c: F.struct(c.word, c.before, c.after)).alias("_own"))
    joined = lines.join(by_line, list(KEY), "left").select("*", F.explode(F.array(X.words(F.col("body")))).alias("_words"))
    good = F.filter("_own", lambda c: (c.word >= 1) & (c.word <= F.size("_words")) & (c.before.isNull() | (c.before == F.get("_words", c.word - 1))))
    joined = joined.withColumn("applied", F.coalesce(F.array_sort(good), F.array().cast("array<struct<word:int,before:string,after:string>>")))
    change = F.map_from_entries(F.transform("applied", lambda c: F.struct(c.word, c.after)))
    final = F.array_join(F.transform("_words", lambda w, i: F.coalesce(F.element_at(F.col("_change"), i + 1), w)), " ")
    joined = joined.withColumn("_change", change)
    # most lines have one change at most: they are cut around it, and only others are gone through word by word
    w, c = F.col("_words"), F.get("applied", 0)
    one = F.array_join(F.concat(F.slice(w, 1, c.word - 1), F.array(F.coalesce(c.after, F.get(w, c.word - 1))), F.slice(w, c.word + 1, F.size(w))), " ")
    return joined.withColumn("final_body", F.when(F.size("applied") == 1, one).when(F.size("applied") > 1, final).otherwise(F.col("body"))).drop("_own", "_words", "_change")


def first_match(words: DataFrame, corrections: DataFrame, group: str) -> DataFrame:
    """``words`` (word) with after: that of the first correction (by ``pos``) of their ``group`` whose ``before`` is the word; null without one.

    Corrections are reduced to one for each group and word before they meet the words.
    """
    first = corrections.groupBy(group, F.col("before").alias("word")).agg(F.min_by("after", "pos").alias("after"))
    return words.join(first, [group, "word"], "left")


def final_texts(overlaid: DataFrame) -> DataFrame:
    """Per page the final text."""
    own = F.array_sort(F.collect_list(F.struct("seq", "final_body")))
    return overlaid.groupBy("doc_id", "page").agg(F.array_join(F.transform(own, lambda x: x.final_body), "\n").alias("text"))


def drop_page(corrections: DataFrame, page) -> DataFrame:
    return corrections.where(F.col("page") != page)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The saved map after an edit: pages of ``new`` replace those of ``old``. Rows carry their place (page, seq, word), in no order."""
    pages = new.select("doc_id", "page").distinct()
    return old.join(pages, ["doc_id", "page"], "left_anti").unionByName(new)


def learned(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs before, after of ``new`` that ``old`` lacks, once each, empty words left out; a word that was confirmed as it is counts too."""
    pairs = new.select("before", "after").where("before <> '' and after <> ''").distinct()
    return pairs.join(old.select("before", "after").distinct(), ["before", "after"], "left_anti")
