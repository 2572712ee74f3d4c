"""Sinks: tables that a job's rows replace as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Write ``rows`` so that each partition they hold replaces the stored one; other partitions stay."""
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def bucketed(key: str, n: int):
    """A bounded partition key for tables of many jobs: the job's hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def replace_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of each key in ``rows`` in place of its own."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def upsert(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Put ``rows`` in place of the stored ones of their keys, in a table of ``buckets`` folders; only folders that hold one of the keys are written.

    Doing it again with the same rows changes nothing.
    """
    fresh = rows.withColumn("bucket", bucketed(key, buckets))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        stored = rows.sparkSession.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched))
        replace_partitions(replace_rows(stored, fresh, key), path, "bucket")


def clear_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def replace_page(jobs: DataFrame, number: int, page: str) -> DataFrame:
    """``jobs`` with the page of that number replaced by the column ``page`` in the nested result."""
    return jobs.withColumn("pages", F.transform("pages", lambda p: F.when(p.page == number, F.col(page)).otherwise(p)))


def new_masters(stored: DataFrame, files: DataFrame) -> DataFrame:
    """sha256, path, length of ``files`` (path, content) whose bytes ``stored`` lacks, once each: what a manifest gains; stored bytes are never written again."""
    found = files.select(F.sha2("content", 256).alias("sha256"), "path", F.length("content").cast("long").alias("length"))
    once = found.groupBy("sha256").agg(F.min(F.struct("path", "length")).alias("f")).select("sha256", "f.*")
    return once.join(stored.select("sha256"), "sha256", "left_anti")


def submitted(uploads: DataFrame) -> DataFrame:
    """New rows of the job table: pending, without a result."""
    return uploads.withColumn("status", F.lit("pending")).withColumn("result_json", F.lit(None).cast("string"))
