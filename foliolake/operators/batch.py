"""Review of many words at once: open words, suggestions, prefills, ticked fixes, single fixes and their undoing.

Words carry doc_id, page, seq, place and word; fixes carry the same place with before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

PLACE = ["doc_id", "page", "seq", "place"]
MOST_SHOWN = 9

# What a suggestion is called by the tier of the correction it comes from.
TIER_SOURCE = {"T1": "swap", "T2": "rule", "T3": "llm"}


def open_words(words: DataFrame, fixed: DataFrame, dictionary: DataFrame, script: X.Script) -> DataFrame:
    """``words`` (with confidence) that a batch run asks about, with ``skipped``: those without any character of the script, which it only counts.

    Doubtful words that nobody has fixed and that the dictionary will not change. Repeated places count once.
    """
    doubtful = words.where(X.band(F.col("confidence")) == "doubt").dropDuplicates(PLACE)
    left = doubtful.join(fixed.select(*PLACE).distinct(), PLACE, "left_anti")
    known = dictionary.where("after <> before").select(F.col("before").alias("word")).distinct()
    return left.join(known, "word", "left_anti").withColumn("skipped", ~F.coalesce(F.col("word").rlike(f"[{script.block}]"), F.lit(False)))


def reading_order(by_number: bool = True) -> list[Column]:
    """Keys that order corrections of a document: line names by their numbers, or letter by letter as saved maps have them (L10 before L2)."""
    name = F.concat(F.lit("L"), F.col("seq").cast("string"))
    return [F.col("page"), F.col("seq") if by_number else name, F.col("place")]


def listed(fixes: DataFrame, by_number: bool = True) -> DataFrame:
    """``fixes`` with ``at``: the place in the document's listing, from 1."""
    return fixes.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(*reading_order(by_number))))


def attach(words: DataFrame, suggestions: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    """``words`` with ``shown`` (array of text, score) and ``prefill``.

    ``words`` may be under correction (``pending``, its tier): that comes first. ``suggestions``: one row per place with before and
    candidates (array of text, score, source); those made for another word than the present one are stale. Candidates
    go by score, ones without a score last, ties as given; the word itself, blanks and repeated texts are left out.
    """
    own = suggestions.select(*PLACE, F.col("before").alias("_before"), F.col("candidates").alias("_candidates"))
    every = words.join(own, PLACE, "left")
    fresh = F.when(F.col("_before").isNull() | (F.col("_before") == F.col("word")), F.col("_candidates"))
    ranked = F.array_sort(F.transform(fresh, lambda c, i: F.struct((-F.coalesce(c.score, F.lit(-1.0))).alias("k"), i.alias("at"), X.strip(c.text).alias("text"), c.score.alias("score"), c.source.alias("source"))))
    shape = "array<struct<text:string,score:double,source:string>>"
    plain = F.transform(F.coalesce(ranked, F.array().cast("array<struct<k:double,at:int,text:string,score:double,source:string>>")), lambda c: F.struct(c.text.alias("text"), c.score.cast("double").alias("score"), c.source.alias("source")))
    tiers = F.create_map(*[F.lit(x) for pair in TIER_SOURCE.items() for x in pair])
    source = F.coalesce(F.try_element_at(tiers, F.col("tier")), F.lit("correction"))
    pending = F.array(F.struct(X.strip(F.col("pending")).alias("text"), F.lit(None).cast("double").alias("score"), source.alias("source")))
    listed = F.concat(F.when(F.col("pending").isNotNull(), pending).otherwise(F.array().cast(shape)), plain.cast(shape))
    good = F.filter("_all", lambda c: (c.text != "") & (c.text != F.col("word")))
    first = F.filter("_good", lambda c, i: F.array_position(F.transform("_good", lambda x: x.text), c.text) == i + 1)
    done = every.withColumn("_all", listed).withColumn("_good", good).withColumn("shown", F.slice(first, 1, most))
    prefill = F.coalesce(F.nullif(F.col("pending"), F.lit("")), F.get("shown", 0)["text"])
    return done.withColumn("prefill", prefill).drop("_before", "_candidates", "_all", "_good")


def prefilled(words: DataFrame, found: DataFrame, fixed: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    """``words`` (with shown) after a batch run's findings came back: the finding heads the list of a word that is open and still reads ``before``."""
    own = found.select(*PLACE, F.col("before").alias("_before"), F.col("after").alias("_after"))
    done = fixed.select(*PLACE).distinct().withColumn("_fixed", F.lit(True))
    every = words.join(own, PLACE, "left").join(done, PLACE, "left")
    takes = F.coalesce((F.col("_before") == F.col("word")) & (F.col("_after") != F.col("word")) & F.col("_fixed").isNull(), F.lit(False))
    head = F.array(F.struct(F.col("_after").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("llm").alias("source")))
    headed = F.slice(F.concat(head, F.filter("shown", lambda c: c.text != F.col("_after"))), 1, most)
    every = every.withColumn("restored", takes).withColumn("shown", F.when(takes, headed).otherwise(F.col("shown")))
    return every.withColumn("prefill", F.when(takes, F.col("_after")).otherwise(F.col("prefill"))).drop("_before", "_after", "_fixed")


def first_open(prefills: DataFrame) -> DataFrame:
    """Per document the first restored prefill in reading order."""
    first = F.min_by(F.struct("page", "seq", "place", "word"), F.struct("page", "seq", "place"))
    return prefills.where("restored").groupBy("doc_id").agg(first.alias("w")).select("doc_id", "w.*")


def neighbour(items: DataFrame, key: str, order: str, step: int = 1) -> DataFrame:
    """``items`` with ``next``: the one ``step`` ahead (or behind) in the key's order, round the ends."""
    window = Window.partitionBy(key).orderBy(order)
    there = F.lead(order, step).over(window) if step > 0 else F.lag(order, -step).over(window)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = (F.first(order) if step > 0 else F.last(order)).over(whole)
    return items.withColumn("next", F.coalesce(there, ends))


def apply_ticked(saved: DataFrame, ticked: DataFrame, words: DataFrame, here: int) -> DataFrame:
    """The saved corrections after ticked fixes were applied, with ``changed``.

    On the page the reviewer sees (``here``) a fix counts if its word still reads ``before`` and has no correction; on other
    pages it replaces what is saved for its place.
    """
    live = words.where(F.col("page") == here).select(*PLACE, F.col("word").alias("before"))
    good_here = ticked.where(F.col("page") == here).join(live, [*PLACE, "before"], "left_semi").join(saved, PLACE, "left_anti")
    good = good_here.unionByName(ticked.where(F.col("page") != here)).select(*PLACE, "before", "after")
    kept = saved.select(*PLACE, "before", "after").join(good, PLACE, "left_anti")
    return kept.withColumn("changed", F.lit(False)).unionByName(good.withColumn("changed", F.lit(True)))


def taught(fixes: DataFrame) -> DataFrame:
    """The reviewer's own dictionary: per word the latest reading (``at``) of fixes that change it."""
    return fixes.where("before <> '' and after <> '' and before <> after").groupBy("before").agg(F.max_by("after", "at").alias("after"))


def undone(saved: DataFrame, undo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The saved corrections without undone automatic fixes, and the skips that keep the dictionary from applying them again."""
    return saved.join(undo, PLACE, "left_anti"), undo.select(*PLACE).distinct()


def reapplied(words: DataFrame, dictionary: DataFrame, fixed: DataFrame, skips: DataFrame) -> DataFrame:
    """Words that the reviewer's dictionary changes on loading: not fixed, not in the automatic band, not undone before."""
    entries = dictionary.where("after <> '' and after <> before").select(F.col("before").alias("word"), "after")
    found = words.where(X.band(F.col("confidence")) != "auto").join(entries, "word")
    return found.join(fixed.select(*PLACE), PLACE, "left_anti").join(skips.select(*PLACE), PLACE, "left_anti")


def settled(saves: DataFrame, key: str, quiet_ms: int = 800) -> DataFrame:
    """Saves that are sent: the last before ``quiet_ms`` without another of the key. ``saves`` has ``at_ms``; ties go by ``save_id``."""
    following = F.lead("at_ms").over(Window.partitionBy(key).orderBy("at_ms", "save_id"))
    return saves.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") - F.col("at_ms") >= quiet_ms)).drop("_next")
