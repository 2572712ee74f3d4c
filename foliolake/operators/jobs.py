"""The job table: listing, states, lookups, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Other services' words for the five states.
STATUS = {
    "uploading": ["in_flight", "upload", "uploading"],
    "queued": ["queued", "waiting"],
    "processing": ["pending", "process", "processing", "running"],
    "done": ["complete", "completed", "done", "ok"],
    "error": ["error", "fail", "failed"],
}
MODES = ("auto", "light", "heavy")


def newest(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the listing: newest first, ties by id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 1..200 and offset not below 0")
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)


def by_id(jobs: DataFrame, job_id) -> DataFrame:
    """The job of an id: a filter that reaches the scan."""
    return jobs.where(F.col("job_id") == F.lit(job_id))


def listed(jobs: DataFrame) -> DataFrame:
    """Summary columns; the result only of failed jobs, counts only of finished ones."""
    done = F.col("status") == "done"
    counts = [F.when(done, F.coalesce(c, F.lit(0))).alias(c) for c in ("page_count", "pages_needing_review", "corrections_count")]
    return jobs.select("job_id", "filename", "status", mode(F.col("mode")).alias("mode"), "created_at", *counts, F.when(F.col("status") == "error", F.get_json_object("result_json", "$.error")).alias("error"))


def mode(value: Column) -> Column:
    """A stored mode; anything unknown is auto."""
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*MODES), clean).otherwise("auto")


def requested_mode(value: Column) -> Column:
    """A requested mode: blank is auto, anything unknown is refused."""
    clean = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(clean == "", "auto").when(clean.isin(*MODES), clean).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), clean)))


def status(value: Column) -> Column:
    pairs = [(alias, name) for name, aliases in STATUS.items() for alias in aliases]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit("processing"))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{32}$"), F.lit(False))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(99), F.floor(done * 100 / total))).otherwise(0).cast("int")


def latest_done(jobs: DataFrame) -> DataFrame:
    """The newest finished job per content and mode, if its result can be reused (``usable``): rank first, then the guard."""
    rank = F.row_number().over(Window.partitionBy("sha256", "mode").orderBy(F.desc("created_at"), F.desc("job_id")))
    return jobs.where("status = 'done'").withColumn("_rank", rank).where("_rank = 1 and usable").drop("_rank")


def duplicates(docs: DataFrame, content: str = "text") -> DataFrame:
    """sha256, the first doc_id, copies, of contents that occur twice or more."""
    return docs.select(F.sha2(content, 256).alias("sha256"), "doc_id").groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def combined_sha256(files: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """One digest for the files of a job in order."""
    own = F.array_sort(F.collect_list(F.struct(order, digest)))
    return files.groupBy(key).agg(F.sha2(F.array_join(F.transform(own, lambda x: x[digest]), "\n"), 256).alias("sha256"))
