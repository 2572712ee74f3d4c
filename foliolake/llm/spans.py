"""Substring deduplication by sliding sentence spans.

Units are sentences: they end with a word that ends in ``.``, ``!`` or ``?``, and at a
line end. Sentences of more than ``LONG_WORDS`` words fall apart where the words themselves
say so, before one whose hash is the least of ``REACH`` words on both sides, so that a passage
without marks has the same units wherever it stands. A span is a run of at
least ``SPAN`` consecutive units, as many as it takes to reach ``SPAN_WORDS`` words, or a whole
text that has fewer; it is hashed over its words, A-Z like a-z. A hash's first occurrence is that in
the document of the smallest doc_id, inside a document the earliest; units
covered by any other occurrence are removed, with the blanks after them.

The first holder of each hash is found by partial minimums, so that a hash
that a third of all spans share is one row per task; its occurrences then are
the long side of a sort-merge join, which Spark splits where it is skewed. No
row stands for a pair of occurrences.

Nulls: a null text has no units and stays null; a null doc_id counts as the
largest. Rows that share a doc_id, repeated ones too, aren't compared with each other, only with other documents. A very
long text is worked on as one slice, some 30 bytes a byte of a task's memory. Empty tables
give empty results; other columns stay as they are, n_units and n_removed of the input are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, stage, sweep, table
from ._groups import shared_keys
from ._words import mixed, powers, slices, word_hashes, words

SPAN = 3
SPAN_WORDS = 12
LONG_WORDS = 16
#: Words on each side that a cut of a long sentence is chosen among.
REACH = 4
LAST = (1 << 63) - 1

_CLOSES = np.zeros(256, bool)
_CLOSES[[ord(c) for c in ".!?"]] = True


def valleys(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Words whose hash lies below those of ``reach`` words before and not above those of ``reach`` words after."""
    edge = np.full(reach, np.iinfo(np.uint64).max)
    low, width = np.concatenate((edge, hashes, edge)), 1
    while 2 * width <= reach:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    n = len(hashes)
    return (hashes < low[:n]) & (hashes <= low[reach + 1 : reach + 1 + n])


def spans(data: np.ndarray, bounds: np.ndarray):
    """For each row of a slice: unit starts (bytes), span keys, and the unit after each span."""
    starts, ends, first = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:])
    for i in range(len(bounds) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            yield np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        closes = _CLOSES[data[ends[a:b] - 1]]
        closes[:-1] |= lines[starts[a + 1 : b]] > lines[ends[a : b - 1]]
        begins = np.concatenate(([True], closes[:-1]))
        sentence = np.cumsum(begins) - 1
        long = np.bincount(sentence)[sentence] > LONG_WORDS
        if long.any():
            begins |= long & valleys(hashes[a:b])
        unit = np.append(np.flatnonzero(begins), b - a)
        n = len(unit) - 1
        until = np.maximum(np.arange(n) + SPAN, np.searchsorted(unit, unit[:-1] + SPAN_WORDS))
        m = int(np.searchsorted(until, n, "right"))
        # a text too short for a span is one itself
        until = until[:m] if m else np.array([n])
        m = len(until)
        # sums of position-weighted hashes, shifted back to the span's start
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(hashes[a:b] * powers(b - a), out=total[1:])
        keys = mixed((total[unit[until]] - total[unit[:m]]) * powers(b - a + 1, True)[unit[:m]])
        yield starts[a:b][unit[:-1]] - bounds[i], keys, until


def _emit(batches):
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        for i, _, data, bounds in slices(batch.column("text")):
            keys, owner = [], []
            for k, (_, own, _) in enumerate(spans(data, bounds)):
                keys.append(np.unique(own))
                owner.append(np.full(len(keys[-1]), docs[i + k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], ["key", "doc"])


def without_repeats(text: bytes, repeated: np.ndarray) -> tuple[bytes, int, int]:
    """The text that stays, its units, and those removed: covered by a repeated key, or by a key seen before in the text."""
    starts, keys, until = next(spans(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    n = len(starts)
    if not len(keys):
        return text, n, 0
    bad = np.isin(keys, repeated)
    _, index = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[index] = False
    bad |= again
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(bad), 1)
    np.add.at(edges, until[bad], -1)
    gone = np.cumsum(edges[:-1]) > 0
    if not gone.any():
        return text, n, 0
    cut = np.append(starts, len(text))
    cut[0] = 0
    return b"".join(text[cut[k] : cut[k + 1]] for k in np.flatnonzero(~gone)), n, int(gone.sum())


def _remove(batches):
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        lists = batch.column("_keys").to_pylist()
        rows = [without_repeats(t or b"", np.array(k or [], np.int64).view(np.uint64)) for t, k in zip(texts, lists)]
        kept = [None if t is None else r[0] for t, r in zip(texts, rows)]
        names = [c for c in batch.schema.names if c not in ("_text", "_keys", "_id")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(kept, pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            [*names, "_kept", "n_units", "n_removed"],
        )


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that lack their repeated spans, and n_units, n_removed."""
    spark = docs.sparkSession
    small_batches(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = lambda: docs.select(doc.alias("doc"), F.col("text").cast("binary").alias("text")).mapInArrow(_emit, "key long, doc long")
    firsts = stage(shared_keys(rows()), "span-firsts")
    sweep(spark)
    flagged = rows().join(firsts, "key").where("doc > first")
    by_doc = stage(flagged.groupBy("doc").agg(F.collect_list("key").alias("_keys")), "span-flags")
    sweep(spark)
    docs = docs.drop("n_units", "n_removed")
    rest = [c for c in docs.columns if c != "text"]
    whole = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("binary").alias("_text"), doc.alias("_id")).join(by_doc.withColumnRenamed("doc", "_id"), "_id", "left")
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("_kept", "binary").add("n_units", "long").add("n_removed", "long")
    out = whole.mapInArrow(_remove, schema)
    return out.select(*[F.col("_kept").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "n_units", "n_removed")


def op2_sentence_spans(spark, sf_dir: str) -> DataFrame:
    """Every document: its units, those removed, and the SHA-256 of what is left."""
    out = remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_units", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
