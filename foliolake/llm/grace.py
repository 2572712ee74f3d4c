"""Exact deduplication by Grace hashing.

Texts are equal when their bytes are after lower-casing A-Z. Records (a text
with the largest doc_id and the number of its rows) are partitioned by bits of
their SHA-256 to spill files, Parquet tables in the shared folder, until every
bucket fits an open-addressing table (:class:`Table`) that compares complete
contents:

1. Each task reads its rows through such a table and spills one record for each
   content that the table holds, so a text that a third of all rows share leaves
   one record a task. A table that is full spills what it has and starts anew.
2. Bucket sizes are sums over two narrow columns. Buckets above ``TABLE_BYTES``
   are read again, pass through the tasks' tables once more, and are partitioned by further bits.
3. Buckets that fit are dealt whole, one table each.

Rows find their group by the digest; only groups of two rows or more are joined.

Of equal texts the row with the largest doc_id stays; a null doc_id is smaller
than any other. Where several rows of a text share that doc_id, one of them stays. Null texts
count as empty ones; empty texts are equal to each other. Texts of any length are compared whole; a text above
``TABLE_BYTES`` has a table for itself. Other columns of the input are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, release, small_batches, stage, sweep, table

#: Bytes of text that a table holds.
TABLE_BYTES = 16 << 20
#: Further bits of a round, and the bits there are.
FINER = 4
BITS = 60

RECORD = "sha binary, h long, text binary, keep long, ties long, n long, n_bytes long"


class Table:
    """An open-addressing table with linear probing. A slot holds the place of an entry, counted from 1; equal hashes are told apart by their contents."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [0] * 1024
        self.hashes: list[int] = []
        self.entries: list[list] = []  # digest, text, largest id, rows with this id, rows
        self.bytes = 0

    def add(self, h: int, sha: bytes, text: bytes, keep: int | None, ties: int, n: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while place := self.slots[at]:
            entry = self.entries[place - 1]
            if self.hashes[place - 1] == h and entry[1] == text:
                entry[4] += n
                if keep == entry[2]:
                    entry[3] += ties
                elif keep is not None and (entry[2] is None or keep > entry[2]):
                    entry[2:4] = keep, ties
                return
            at = (at + 1) & mask
        self.hashes.append(h)
        self.entries.append([sha, text, keep, ties, n])
        self.slots[at] = len(self.entries)
        self.bytes += len(text)
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [0] * (mask + 1)
        for place, h in enumerate(self.hashes, 1):
            at = h & mask
            while self.slots[at]:
                at = (at + 1) & mask
            self.slots[at] = place

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The records, in batches of a bounded size, in order of their hashes; the table is empty afterwards."""
        order = sorted(range(len(self.hashes)), key=self.hashes.__getitem__)
        rows, size = [], 0
        for i in order:
            sha, text, keep, ties, n = self.entries[i]
            rows.append((sha, self.hashes[i], text, keep, ties, n, len(text)))
            size += len(text)
            if size > 1 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        self.clear()


_TYPES = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], ["sha", "h", "text", "keep", "ties", "n", "n_bytes"])


def normalised(text: bytes | None) -> bytes:
    return (text or b"").lower()  # of bytes: A-Z only


def prefix(sha: bytes) -> int:
    return int.from_bytes(sha[:8]) >> (64 - BITS)


def _records(most: int):
    """Rows to records: one for each content that a task's table holds."""

    def run(batches):
        own = Table()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = normalised(text)
                sha = hashlib.sha256(text).digest()
                own.add(prefix(sha), sha, text, doc, 1, 1)
                if own.bytes > most:
                    yield from own.spill()
        yield from own.spill()

    return run


def _merged(most: int):
    """Records to fewer records, through a task's table."""

    def run(batches):
        own = Table()
        for b in batches:
            for sha, h, text, keep, ties, n in zip(*[b.column(c).to_pylist() for c in ("sha", "h", "text", "keep", "ties", "n")]):
                own.add(h, sha, text, keep, ties, n)
                if own.bytes > most:
                    yield from own.spill()
        yield from own.spill()

    return run


def _bucket(batches):
    """All records of a bucket, in batches, to its groups."""
    own = Table()
    for b in batches:
        for sha, h, text, keep, ties, n in zip(*[b.column(c).to_pylist() for c in ("sha", "h", "text", "keep", "ties", "n")]):
            own.add(h, sha, text, keep, ties, n)
    rows = [(sha, keep, ties, n) for sha, _, keep, ties, n in own.entries]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["sha", "keep_id", "ties", "group_size"])


def groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """sha, keep_id, ties (rows with that id), group_size of each text of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spill = stage(rows.mapInArrow(_records(table_bytes), RECORD), "grace-spill")
    total = spill.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / table_bytes)))) + 1)
    found = None
    while True:
        bucket = F.shiftright("h", BITS - bits)
        sizes = spill.groupBy(bucket.alias("bucket")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        over = (F.col("b") > table_bytes) & (F.col("n") > 1) if bits < BITS else F.lit(False)
        large = few(stage(sizes.where(over).select("bucket"), "grace-large"))
        some = large.limit(1).count()
        dealt = spill.withColumn("bucket", bucket)
        whole = dealt.join(large, "bucket", "left_anti") if some else dealt
        own = stage(whole.groupBy("bucket").applyInArrow(_bucket_of, "sha binary, keep_id long, ties long, group_size long"), "grace-groups")
        found = own if found is None else found.unionByName(own)
        if not some:
            release(spill)
            sweep(spark)
            return found
        again = stage(dealt.join(large, "bucket", "left_semi").drop("bucket").mapInArrow(_merged(table_bytes), RECORD), "grace-spill")
        release(spill)
        sweep(spark)
        spill, bits = again, min(BITS, bits + FINER)


def _bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _bucket(batches)


def _digests(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha256(normalised(t)).digest() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "sha"])


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    every = groups(docs, table_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_digests, "doc_id long, sha binary")
    rows = stage(rows.withColumn("place", F.monotonically_increasing_id()), "grace-digests")
    several = every.where("group_size > 1")
    # where rows of a text share the largest id, the first of them stays
    tied = several.where("ties > 1").select("sha", "keep_id")
    if tied.limit(1).count():
        first = rows.join(few(tied), "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("place").alias("first"))
        several = stage(several.join(first, "sha", "left"), "grace-several")
    else:
        several = several.withColumn("first", F.lit(None).cast("long"))
    joined = rows.join(few(several.select("sha", "keep_id", "group_size", "first")), "sha", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("first").isNull() | (F.col("place") == F.col("first"))))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op13_grace_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""
