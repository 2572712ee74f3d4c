"""Streams that keep state by key: what a word's corrections amount to, and how far a job is.

Events may come twice and out of order within ``late`` of the newest one; older ones are left out by the watermark. So an event id needs to
be remembered only until the watermark has passed it: timers drop what is older, and a key's state stays as small as its recent events.
Each batch gives the whole state of the keys that it changed, and the table of states has one row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources import tables

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 8

# ``turn`` orders what a key gives in one batch: its input's state first, then that of its timers
WORD = "before string, after string, accepts long, skips long, updated_at long, turn int"
JOB = "job_id long, status string, pages_done long, updated_at long, turn int"


class _Keyed(StatefulProcessor):
    """Events of a key, each once. State is read and written once a batch, however many events there are; times are microseconds (``us``)."""

    def __init__(self, late_ms: int) -> None:
        self.late_ms = late_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ids array<long>, ats array<long>")

    def fresh(self, rows: Iterator[Row]) -> list[Row]:
        """The rows whose ids are new, which are remembered."""
        known = dict(zip(*(self.seen.get() if self.seen.exists() else ([], []))))
        new = []
        for r in rows:
            if r.event_id not in known:
                known[r.event_id] = r.us // 1000
                new.append(r)
        if new:
            self.seen.update((list(known), list(known.values())))
            self.handle.registerTimer(max(known.values()) + self.late_ms)
        return new

    def forget(self, watermark: int) -> None:
        if self.seen.exists():
            known = [(i, at) for i, at in zip(*self.seen.get()) if at >= watermark]
            self.seen.update(([i for i, _ in known], [at for _, at in known]))

    def close(self) -> None:
        pass


class Words(_Keyed):
    """accepts, skips and the replacement of a word: that of its latest accept, or without one that of its first skip."""

    def init(self, handle) -> None:
        super().init(handle)
        self.word = handle.getValueState("word", "after string, at long, id long, accepts long, skips long, updated long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = self.fresh(rows)
        if not new:
            return
        after, at, own, accepts, skips, updated = self.word.get() if self.word.exists() else (None, None, None, 0, 0, None)
        for r in new:
            place, accepted = (r.us, r.event_id), r.kind == "accept"
            if own is None or (accepted and (not accepts or place > (at, own))) or (not accepted and not accepts and place < (at, own)):
                after, at, own = r.after, r.us, r.event_id
            accepts, skips = accepts + accepted, skips + (not accepted)
            updated = r.us if updated is None else max(updated, r.us)
        self.word.update((after, at, own, accepts, skips, updated))
        yield Row(before=key[0], after=after, accepts=accepts, skips=skips, updated_at=updated, turn=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget(timerValues.getCurrentWatermarkInMs())
        yield from ()


class Jobs(_Keyed):
    """The status of a job by its latest change, the pages done, and ``lost`` for one that was pending when nothing had come for ``patience``."""

    def __init__(self, late_ms: int, patience_ms: int) -> None:
        super().__init__(late_ms)
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, at long, id long, pages long, updated long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = self.fresh(rows)
        if not new:
            return
        status, at, own, pages, updated = self.job.get() if self.job.exists() else ("pending", None, None, 0, None)
        for r in new:
            if r.status is not None and (own is None or (r.us, r.event_id) > (at, own)):
                status, at, own = r.status, r.us, r.event_id
            pages += r.pages
            updated = r.us if updated is None else max(updated, r.us)
        self.job.update((status, at, own, pages, updated))
        if status == "pending":
            self.handle.registerTimer(updated // 1000 + self.patience_ms)
        yield Row(job_id=key[0], status=status, pages_done=pages, updated_at=updated, turn=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.forget(watermark)
        status, _, _, pages, updated = self.job.get()
        if status == "pending" and updated // 1000 + self.patience_ms <= watermark:
            yield Row(job_id=key[0], status="lost", pages_done=pages, updated_at=updated, turn=1)


def _run(states: DataFrame, key: str, schema: str, path: str) -> DataFrame:
    """Run a stream of states to the end of its input; the table of the last state of every key.

    A key may give several states in a batch (its input's, and one for each timer that ends in it); the last one counts.
    """
    spark = states.sparkSession
    table, schema = f"{path}/states", schema.replace("updated_at long, turn int", "updated_at timestamp")
    spark.createDataFrame([], f"{schema}, bucket int").write.mode("append").parquet(table)
    states = states.withColumn("updated_at", F.timestamp_micros("updated_at"))

    def keep(batch: DataFrame, number: int) -> None:
        names = [c for c in batch.columns if c != "turn"]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*names), "turn").alias("s")).select("s.*").persist()
        tables.upsert(last, table, key, BUCKETS)
        last.unpersist()

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        stream = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
    stream.awaitTermination()
    return spark.read.schema(f"{schema}, bucket int").parquet(table).drop("bucket")


def words(log: DataFrame, path: str, late_seconds: int) -> DataFrame:
    """``log``: a stream of event_id, ts (timestamp), kind, before, after. Folded by word; ``path`` keeps state and result from run to run."""
    rows = log.withColumn("us", F.unix_micros("ts")).withWatermark("ts", f"{late_seconds} seconds").groupBy("before")
    return _run(rows.transformWithState(Words(1000 * late_seconds), WORD, "update", "eventTime"), "before", WORD, path)


def jobs(feed: DataFrame, path: str, late_seconds: int, patience_seconds: int) -> DataFrame:
    """``feed``: a stream of event_id, ts (timestamp), job_id, status (null: none told), pages (done since)."""
    rows = feed.withColumn("us", F.unix_micros("ts")).withWatermark("ts", f"{late_seconds} seconds").groupBy("job_id")
    return _run(rows.transformWithState(Jobs(1000 * late_seconds, 1000 * patience_seconds), JOB, "update", "eventTime"), "job_id", JOB, path)
