"""States and labels of pages, uploads and exports, and how calls are retried, as expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Engines by profile, their names, and the waits of the upload page in milliseconds.
ROUTES = {"FAST": ("gemini", "sarvam"), "HEAVY": ("sarvam", "gemini")}
ENGINES = {"gemini": "Gemini", "sarvam": "Sarvam", "stub": "No OCR"}
FIRST_GAP, MOST_GAP = 800, 3000
FIRST_WAIT, MOST_WAIT = 1000, 10000
CLOCK_SLACK = 15


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in values.items() for x in pair]), key)


def route(profile: Column, selected: str = "gemini") -> Column:
    """The engines of a page in order; an unknown profile has the selected one alone."""
    return F.coalesce(_lookup({k: F.array(*[F.lit(e) for e in v]) for k, v in ROUTES.items()}, profile), F.array(F.lit(selected)))


def is_fallback(engine: Column, profile: Column, selected: str = "gemini") -> Column:
    """Whether another engine than the route's first read the page; null where the engine isn't known."""
    return F.when(engine.isNotNull(), engine != F.get(route(profile, selected), 0))


def engine_tag(engine: Column, fallback: Column, ms: Column) -> Column:
    """The engine's name, a mark of fallback, and seconds with one decimal below ten; null for unknown engines. ``ms`` is whole."""
    mark = F.when((engine != "stub") & fallback, " (fallback)").otherwise("")
    # halves whose double lies below them round down
    low = [k for k in range(50, 10000, 100) if Decimal(k / 1000) < Decimal(k) / 1000]
    tenths = F.floor((ms + 50) / 100) - F.when(ms.isin(low), 1).otherwise(0)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    seconds = F.when(ms < 10000, short).otherwise(F.floor(ms / 1000 + 0.5).cast("string"))
    time = F.when(ms > 0, F.concat(F.lit(" · "), seconds, F.lit("s"))).otherwise("")
    return F.concat(_lookup(ENGINES, engine), F.coalesce(mark, F.lit("")), F.coalesce(time, F.lit("")))


def page_state(profile: Column, needs_review: Column, preprocessed: Column, loaded: Column) -> Column:
    """What the editor says of a page; flags that are null don't hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((profile == "HEAVY") & (yes(preprocessed) | yes(loaded)), "repaired")
        .when((profile == "FAST") & ~yes(needs_review), "clean")
        .when(yes(preprocessed), "precomputed")
        .when(yes(loaded), "ready")
        .otherwise("queued")
    )


def review_bin(confidence: Column, profile: Column, needs_review: Column, floor: float = X.LINE_FLOOR) -> Column:
    """The band of a line, doubt below ``floor`` on pages that a person must see."""
    flagged = F.coalesce(needs_review, F.lit(False)) | F.coalesce(profile == "HEAVY", F.lit(False))
    return F.when(flagged & (confidence < floor), "doubt").otherwise(X.band(confidence))


def export_state(job: Column, save_mode: Column, failed: Column, dirty: Column, fixes: Column, mock: bool = False) -> Column:
    """Whether an export holds the reviewer's fixes."""
    return (
        F.when(F.lit(mock) | job.isNull() | (job == ""), "demo")
        .when(save_mode == "local", "local")
        .when(F.coalesce(failed, F.lit(False)), "error")
        .when(F.coalesce(dirty, F.lit(False)) & (fixes > 0), "unsynced")
        .otherwise("saved")
    )


def page_summary(pages: Column, review: Column) -> Column:
    """The line under an upload: its pages and those to review; empty without pages."""
    many = F.when(pages == 1, " page").otherwise(" pages")
    tail = F.when(review > 0, F.concat(F.lit(" · "), review.cast("string"), F.lit(" to review"))).otherwise("")
    return F.when(pages > 0, F.concat(F.lit(" · "), pages.cast("string"), many, tail)).otherwise("")


def upload_share(status: Column, sent: Column, read: Column, seconds: Column) -> Column:
    """How far an upload is, 0 to 1: a third for sending, then by the reported percentage or, without one, by time."""
    known = 0.35 + 0.62 * F.least(F.lit(1.0), read / 100)
    guess = 0.35 + 0.62 * (1 - F.exp(-F.coalesce(seconds, F.lit(0.0)) / 6))
    return (
        F.when(status.isin("done", "error"), 1.0)
        .when(status == "uploading", 0.35 * F.least(F.lit(1.0), F.coalesce(sent, F.lit(0.0)) / 100))
        .when(status == "processing", F.when(read.isNotNull(), known).otherwise(guess))
        .otherwise(0.0)
    )


def poll_gap(polls: Column) -> Column:
    """The wait after poll number ``polls`` (from 0): half as long again each time, to the whole millisecond, up to the most."""
    longer = lambda gap, _: F.least(F.lit(MOST_GAP), F.floor(gap * 1.5 + 0.5).cast("int"))
    # the most is reached within a few polls, so the fold's length is bounded
    steps = F.when(polls > 0, F.sequence(F.lit(1), F.least(polls, F.lit(8)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(FIRST_GAP), longer)


def retry_wait(failures: Column, jitter: Column) -> Column:
    """The wait after so many failures in a row: doubled up to the most, times 0.8 to 1.2 for a jitter of 0 to 1."""
    base = F.least(F.lit(float(MOST_WAIT)), FIRST_WAIT * F.pow(F.lit(2.0), F.greatest(F.lit(0), failures - 1)))
    return F.floor(base * (0.8 + jitter * 0.4) + 0.5).cast("int")


def lost_replies(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """``uploads`` (upload_id, sha256, filename, mode, started_at) without a reply, with the job_id they became, if any.

    The newest job of the same content (of the same name where no digest is known), not older than the start less the clocks'
    slack, of the same mode where both are known. An equi-join per kind of key, so no upload meets every job.
    """
    right = jobs.select(F.col("sha256").alias("_sha"), F.col("filename").alias("_name"), F.col("mode").alias("_mode"), "job_id", "created_at")
    fits = (F.col("created_at") >= F.col("started_at") - F.expr(f"INTERVAL {CLOCK_SLACK} SECONDS")) & (F.col("mode").isNull() | F.col("_mode").isNull() | (F.col("mode") == F.col("_mode")))
    hashed, named = uploads.where("coalesce(sha256, '') <> ''"), uploads.where("coalesce(sha256, '') = ''")
    met = hashed.join(right, (F.col("sha256") == F.col("_sha")) & fits).unionByName(named.join(right, (F.col("filename") == F.col("_name")) & fits))
    newest = met.groupBy("upload_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
    return uploads.join(newest, "upload_id", "left")


def status_feed(changes: DataFrame, key: str) -> DataFrame:
    """The state of each job: its latest change by ``at``, ties by ``change_id``; repeated changes do no harm."""
    return changes.groupBy(key).agg(F.max_by(F.struct("status", "at"), F.struct("at", "change_id")).alias("c")).select(key, "c.*")


def retry_pause(attempt: Column, asked: Column) -> Column:
    """Seconds before the next try of a service: two to the power of the attempts so far, or what the service asks for if that is longer."""
    return F.greatest(F.pow(F.lit(2.0), attempt), F.coalesce(asked.try_cast("double"), F.lit(0.0)))


def with_retries(calls: DataFrame, deadline: float, most: int = 5) -> DataFrame:
    """Per call_id of a log of answers (attempt from 1, at: seconds since the call began, status: null without an answer): what the caller gets.

    Busy and missing answers are tried again, ``most`` times in all and while the pause ends before the deadline; any other answer ends the call.
    Columns: attempts, status, ok, outage (the service failed or time ran out).
    """
    again = F.col("status").isNull() | F.col("status").isin(429, 503)
    late = F.col("at") + retry_pause(F.col("attempt"), F.col("retry_after")) > deadline
    rows = calls.where(F.col("attempt") <= most).withColumn("_ends", ~again | (F.col("attempt") == most) | late)
    end = F.min(F.when(F.col("_ends"), F.struct("attempt", "status", (again & late & (F.col("attempt") < most)).alias("late"))))
    done = rows.groupBy("call_id").agg(end.alias("e")).where("e is not null").select("call_id", "e.*")
    status = F.col("status")
    return done.select("call_id", F.col("attempt").alias("attempts"), "status", F.coalesce(status < 400, F.lit(False)).alias("ok"), (F.coalesce(status >= 500, F.lit(True)) | F.col("late")).alias("outage"))


def page_engines(bands: DataFrame, primary: str) -> DataFrame:
    """Per page of banded reading the engine: the first band's that fell back, else the first that read; stub if every band failed, null if none is known."""
    real = F.col("engine").isNotNull() & (F.col("engine") != "stub")
    first = lambda when: F.min(F.when(when, F.struct("band", "engine")))["engine"]
    return bands.groupBy("page").agg(
        F.when(F.every(F.coalesce(F.col("engine") == "stub", F.lit(False))), "stub").otherwise(F.coalesce(first(real & (F.col("engine") != primary)), first(real))).alias("engine")
    )
