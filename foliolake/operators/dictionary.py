"""The correction dictionary, folded from an append-only log of accepts and skips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(events: DataFrame) -> DataFrame:
    """``events``: event_id, ts, kind (accept, skip), before, after. Per word: after, accepts, skips, updated_at.

    The latest accept names ``after``; without one, the first skip. Repeated event ids count once, so replays do no harm.
    """
    once = events.dropDuplicates(["event_id"])
    accept = F.col("kind") == "accept"
    return once.groupBy("before").agg(
        F.coalesce(F.max_by("after", F.when(accept, F.struct("ts", "event_id"))), F.min_by("after", F.struct("ts", "event_id"))).alias("after"),
        F.count_if(accept).alias("accepts"),
        F.count_if(~accept).alias("skips"),
        F.max("ts").alias("updated_at"),
    )


def gated(dictionary: DataFrame, least: int = 2) -> DataFrame:
    """Entries that may be suggested."""
    return dictionary.where((F.col("accepts") >= least) & (F.col("accepts") > F.col("skips")))


def top(dictionary: DataFrame, limit: int = 200) -> DataFrame:
    return dictionary.orderBy(F.desc("accepts"), F.desc("updated_at"), "before").limit(limit)


def auto_apply(words: DataFrame, dictionary: DataFrame, fixed: DataFrame) -> DataFrame:
    """Words below the automatic band that the dictionary changes and nobody has fixed."""
    return words.where("band <> 'auto'").join(gated(dictionary).select(F.col("before").alias("word"), "after"), "word").where("after <> word").join(fixed, ["doc_id", "page", "seq", "place"], "left_anti")


def overlay(local: DataFrame, server: DataFrame) -> DataFrame:
    """Both dictionaries, the server's entries first."""
    return server.unionByName(local.join(server, "before", "left_anti"))


def sliding_count(events: DataFrame, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """``events`` with n: those of the key in the last ``seconds``, itself included."""
    window = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count(F.lit(1)).over(window))


def breaker(events: DataFrame, failed, key: str = "user_id") -> DataFrame:
    """``events`` with open: whether an earlier call of the key has failed; such a breaker stays open."""
    before = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("open", F.coalesce(F.max(failed).over(before), F.lit(False)))


def running_budget(files: DataFrame, size: str, key: str, order: list[str], most: int) -> DataFrame:
    """``files`` with used (bytes up to and with each) and fits."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("used", F.sum(size).over(upto)).withColumn("fits", F.col("used") <= most)
