"""How filters interact: what each removes, alone and after others, in every order.

Each document gets a mask of the filters that it fails; a part's counters over
masks are additive, and everything asked about the orders follows from at most 32
counters a part.

Duplicates are found by sorting. Rows are dealt into ranges of (text
fingerprint, doc_id), so a text that a third of all rows share is spread over
many tasks, and sorted in each by fingerprint, whole text and doc_id. A row
whose run of equal texts began with a smaller doc_id fails. Runs under a task's
first or last fingerprint may go on in its neighbours: for them a task hands
out the text and its least doc_id, the least over all tasks is found, and only
the rows with the task's least doc_id have to wait for it.

Nulls: a null text is empty; a null lang is the part ``''``, like an empty one; a null doc_id counts as the largest, and
rows that share a doc_id (or have none) aren't duplicates of each other. Labels
of one doc_id are joined by any; null labels count as 0. A text of any length is one row; a
task holds two of them at a time. Clashing and extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, small_batches, stage, sweep, table

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
DUPLICATE = 1 << FILTERS.index("E")

_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_LATER_BYTES = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A-D that the text fails, by itself."""
    words = text.split()  # of bytes: by the six ASCII blanks
    without = lambda drop: len(text) - len(text.translate(None, drop))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * without(_CAPITALS) > MOST_CAPITALS * (len(text) - without(_LATER_BYTES)),
        without(_MARKS) > 0,
    )
    return sum(1 << k for k, f in enumerate(failed) if f)


_MASKS = "doc_id long, part string, mask int, n long, fp long, edge binary"
_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], ["doc_id", "part", "mask", "n", "fp", "edge"])


def _masks(batches):
    """Sorted rows to masks. ``edge`` is the text of rows whose run may have begun in another task; their bit of E is open."""
    first_fp = fp = text = least = base = None
    waiting: Counter[str] = Counter()  # parts of the rows with the run's least doc_id
    open_runs: list[tuple] = []  # of the current fingerprint: what waits, in case it is the task's last
    out: list[tuple] = []

    def close(at_edge: bool) -> None:
        """The current fingerprint is over."""
        for doc, parts, mask, whole in open_runs:
            out.extend((doc, part, mask, n, fp if at_edge else None, whole if at_edge else None) for part, n in parts.items())
        open_runs.clear()

    for b in batches:
        for doc, part, row_fp, row_text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "part", "fp", "text")]):
            if first_fp is None:
                first_fp = row_fp
            same = text is not None and row_fp == fp and row_text == text
            if same and doc != least:
                out.append((doc, part, base | DUPLICATE, 1, None, None))
                continue
            if not same:
                if text is not None:
                    open_runs.append((least, waiting, base, text))
                    if row_fp != fp:
                        close(fp == first_fp)
                fp, text, least, base, waiting = row_fp, row_text, doc, failures(row_text), Counter()
            waiting[part] += 1
        if len(out) >= 5000:
            yield _batch(out)
            out = []
    if text is not None:
        open_runs.append((least, waiting, base, text))
        close(True)
    if out:
        yield _batch(out)


def masks(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """doc_id, part, mask, n (rows that it stands for): what each row of ``docs`` (doc_id, text, lang) fails."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), fingerprint(text).alias("fp"), text.alias("text"))
    last = F.col("doc_id").asc_nulls_last()
    found = stage(rows.repartitionByRange("fp", last).sortWithinPartitions("fp", "text", last).mapInArrow(_masks, _MASKS), "audit-masks")
    sweep(docs.sparkSession)
    inner = found.where("edge is null").select("doc_id", "part", "mask", "n")
    edges = found.where("edge is not null")
    least = edges.groupBy("fp", "edge").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    again = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id") > F.col("least")
    settled = edges.join(least, ["fp", "edge"]).select("doc_id", "part", F.when(again, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"), "n")
    return inner.unionByName(settled)


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic over ``found`` (:func:`masks`)."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic")).where("quality + toxic > 0")
    # rows without an id have no label; they'd all meet in one task of a shuffled join
    marked = found.where("doc_id is not null").join(few(stage(named, "audit-labels")), "doc_id", "left")
    without = found.where("doc_id is null").withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    total = lambda c, name: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)).alias(name)
    return marked.unionByName(without.select(*marked.columns)).groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality", "good"), total("toxic", "toxic_n"))


def interactions(counted: DataFrame) -> DataFrame:
    """A row for each part, order and step from the counters."""
    steps = F.array(
        *[
            F.struct(F.lit("".join(order)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(c)) for c in order]).alias("bits"))
            for order in itertools.permutations(FILTERS)
        ]
    )
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic_n")).alias("c"))  # at most 32
    each = parts.select("part", "c", F.explode(steps).alias("o")).select("part", "c", "o.filter_order", F.posexplode("o.bits").alias("k", "bit"), F.col("o.bits").alias("bits"))
    each = each.withColumn("before", F.aggregate(F.slice("bits", 1, F.col("k")), F.lit(0), lambda a, x: a.bitwiseOR(x)))

    def total(what, holds):
        return F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(holds(x["mask"]), x[what]).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    rows = each.select(
        "part",
        "filter_order",
        (F.col("k") + 1).cast("int").alias("step"),
        "bit",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic_n", here).alias("toxic_lost"),
    )
    values = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(values, ["part", "bit"]).drop("bit")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters, by part."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = stage(counters(masks(docs.select("doc_id", "text", "lang")), labels.select("doc_id", "quality", "toxic")), "audit-counters")
    return interactions(counted)


ORACLE = r"""
WITH w AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
m AS (SELECT part, doc_id, t, (len(x) < 200)::INTEGER AS fa, (100 * len(list_distinct(x)) < 50 * len(x))::INTEGER AS fb,
             (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INTEGER AS fc, regexp_matches(t, '[#$%&*|]')::INTEGER AS fd,
             (doc_id > MIN(doc_id) OVER (PARTITION BY t))::INTEGER AS fe FROM w),
l AS (SELECT doc_id, MAX((quality = 1)::INTEGER) AS good, MAX((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, COUNT(*) AS n, COALESCE(SUM(good), 0) AS good, COALESCE(SUM(toxic), 0) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS f, UNNEST([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM s a JOIN s b ON b.f <> a.f JOIN s c ON c.f NOT IN (a.f, b.f) JOIN s d ON d.f NOT IN (a.f, b.f, c.f) JOIN s e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
k AS (SELECT filter_order, step, bits[step] AS bit, COALESCE(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT UNNEST(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
        COALESCE(SUM(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, COALESCE(SUM(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
        COALESCE(SUM(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, COALESCE(SUM(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        COALESCE(SUM(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, COALESCE(SUM(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, k GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (SUM(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
