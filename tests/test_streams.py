"""Streams with state: replayed and out-of-order events give what a batch over all events gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliolake.plans import table_queries
from foliolake.streaming import feeds, review

from .conftest import DATA

START = datetime(2026, 3, 1)
LOG = "event_id long, ts timestamp, kind string, before string, after string"
FEED = "event_id long, ts timestamp, job_id long, status string, pages int"


def batches(spark, path, parts, schema):
    """A stream that reads one of ``parts`` a batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_replays_and_disorder_change_nothing(spark, tmp_path):
    r = random.Random(5)
    events = [(k, START + timedelta(minutes=7 * k), r.choice(["accept", "skip", "skip"]), f"w{r.randrange(8)}", f"a{r.randrange(4)}") for k in range(400)]
    moved = sorted(events, key=lambda e: e[0] + r.randrange(60))  # up to seven hours late
    parts = [moved[k : k + 80] for k in range(0, 400, 80)]
    parts = [p + r.sample(moved[max(0, 80 * k - 40) : 80 * k + 80], 30) for k, p in enumerate(parts)]  # again, within the delay and in the same batch
    found = review.words(batches(spark, tmp_path, parts, LOG), str(tmp_path / "out"), 12 * 3600)
    wanted = {}
    for w in {e[3] for e in events}:
        own = [e for e in events if e[3] == w]
        accepted = [e for e in own if e[2] == "accept"]
        wanted[w] = ((max(accepted, key=lambda e: e[:2][::-1]) if accepted else min(own, key=lambda e: e[:2][::-1]))[4], len(accepted), len(own) - len(accepted), max(e[1] for e in own))
    rows = found.collect()
    assert len(rows) == len(wanted) and {x.before: (x.after, x.accepts, x.skips, x.updated_at) for x in rows} == wanted


def test_a_silent_job_is_lost_until_it_is_heard_of_again(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    parts = [
        [(1, at(0), 1, "pending", 0), (2, at(0), 2, "pending", 0), (3, at(0), 3, "pending", 0), (4, at(1), 3, None, 1), (5, at(0.5), 4, None, 2)],
        [(6, at(2), 2, "done", 1), (7, at(1), 2, "error", 0), (4, at(1), 3, None, 1)],
        [(8, at(20), 9, "done", 0)],  # ten hours of patience are over for 1, 3 and 4
        [(9, at(20.5), 9, None, 0)],
        [(10, at(21), 3, "done", 1), (11, at(19.5), 1, "pending", 0), (1, at(0), 1, "pending", 0)],
        [(12, at(60), 9, None, 0)],
    ]
    found = {x.job_id: (x.status, x.pages_done) for x in review.jobs(batches(spark, tmp_path, parts, FEED), str(tmp_path / "out"), 3600, 36000).collect()}
    assert found == {1: ("lost", 0), 2: ("done", 1), 3: ("done", 2), 4: ("lost", 2), 9: ("done", 0)}


def test_jobs_of_the_query_are_lost_too(spark, compare):
    got = table_queries.job_status_stream(spark, DATA).groupBy("status").count().collect()
    assert len(got) > 1 and sum(x["count"] for x in got) == spark.read.parquet(f"{DATA}/events.parquet").agg(F.countDistinct("user_id")).first()[0]


def test_a_lost_job_has_one_row(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    # both timers of job 1 end in one batch; job 2 is heard of in the batch in which its patience ends
    parts = [[(1, at(0), 1, "pending", 0)], [(2, at(100), 9, "done", 0)], [(3, at(99.5), 2, "pending", 1), (4, at(200), 9, None, 1)]]
    found = review.jobs(batches(spark, tmp_path, parts, FEED), str(tmp_path / "out"), 3600, 36000).collect()
    assert sorted((x.job_id, x.status, x.pages_done) for x in found) == [(1, "lost", 0), (2, "lost", 1), (9, "done", 1)]


def test_files_in_any_order_make_no_event_late(spark, tmp_path):
    path = tmp_path / "events.parquet"
    path.mkdir()
    for k in range(40):  # the newest file first
        ts = F.lit(START + timedelta(days=40 - k)).cast("timestamp_ntz")
        one = spark.range(1).select(F.lit(k).cast("long").alias("event_id"), ts.alias("ts"), F.lit(k).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
        one.coalesce(1).write.parquet(str(path / f"{k:02d}.parquet"))
    assert feeds.job_feed(spark, str(tmp_path), str(tmp_path / "out")).where("status = 'done'").count() == 40
