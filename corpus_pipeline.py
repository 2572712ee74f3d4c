"""A corpus from raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the last have
the columns of ``documents``. A document is its doc_id and its text: rows that agree in both go or stay
together (in the second stage one of them stays), rows that share the doc_id alone, or have none, are judged one by one. Null and empty texts have too
few words and go in the first stage. Whole texts of any length are worked on; clashing and extra columns are
carried, but for those that the last stage adds, which replace the input's. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import decontamination, mixing, ngram_join, quality, sharding
from foliolake.llm._common import few, stage, sweep, table

#: Near copies share this percentage of their runs of so many words.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents ``gone`` (doc_id, fp: the hash of the text)."""
    gone = few(stage(gone.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct(), "pipeline-gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_fp")), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return without(docs, quality.judge(docs).where("not kept"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest number stays; links are looser here than in op9_ngram_jaccard.

    Documents are numbered by doc_id, nulls last, and text, so that those that share an id are told apart; of rows that agree in
    both one stays.
    """
    names = docs.columns
    several = stage(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "pipeline-several")
    if several.limit(1).count():
        # documents of an id that repeats get negative numbers of their own
        docs = docs.withColumn("_print", F.xxhash64("text")).dropDuplicates(["doc_id", "_print"]).drop("_print")
        shared = few(several.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several")))
        marked = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        number = F.when(F.col("_several"), -1 - F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.col("doc_id").cast("long"))
        docs = marked.withColumn("_number", number).drop("_several")
    else:
        docs = docs.withColumn("_number", F.col("doc_id").cast("long"))
    found = ngram_join.linked(docs.select(F.col("_number").alias("doc_id"), "text"), words_each=NEAR_WORDS, percent=NEAR_PERCENT)
    others = few(stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct(), "pipeline-gone"))
    return docs.join(others, F.col("_number") == F.col("_other"), "left_anti").select(*[F.col(f"`{c}`") for c in names])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return without(docs, decontamination.leaks(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards."""
    return sharding.assign(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the robust estimates and the latent search; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
            sweep(spark)
    return docs
