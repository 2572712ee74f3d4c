"""Streams over the event log: the dictionary, the status of jobs and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import review

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of files; ts as a timestamp, as watermarks need it.

    Files that are there at the start make one batch, as their order is not that of the events: none may be late because of another file.
    """
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def folded_log(spark: SparkSession, sf_dir: str, path: str, late_seconds: int = 7 * 86400) -> DataFrame:
    """The dictionary as a stream: the log folded by word."""
    kind = F.when(F.col("event_type").isin("purchase", "click", "signup"), "accept").otherwise("skip")
    log = events(spark, sf_dir).select("event_id", "ts", kind.alias("kind"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("before"), F.col("event_type").alias("after"))
    return review.words(log, path, late_seconds)


def job_feed(spark: SparkSession, sf_dir: str, path: str, late_seconds: int = 3600, patience_seconds: int = 2 * 86400) -> DataFrame:
    """Users as jobs: signups submit them, clicks are pages done, purchases finish them."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    feed = events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("job_id"), status.alias("status"), (F.col("event_type") == "click").cast("int").alias("pages"))
    return review.jobs(feed, path, late_seconds, patience_seconds)


def windowed_counts(spark: SparkSession, sf_dir: str, path: str, width: str = "1 day", late: str = "400 days") -> DataFrame:
    """Events by window and type. Update mode: each batch's changed windows are kept, the latest count holds."""
    counts = events(spark, sf_dir).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/state/part={number}")
    stream = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{path}/state").groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
