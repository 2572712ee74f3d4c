"""Suffix-array deduplication by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document of a smaller doc_id. Two stages keep the suffix array small and spread:

1. Anchors. The anchor of a window of ``LENGTH`` bytes is the least hash of its
   ``GRAM``-byte strings, so equal windows have equal anchors; runs of windows
   with one anchor are a stretch of text. Anchors that two documents share are
   found by partial minimums and maximums; no other window can repeat.
2. Suffixes. Stretches of shared anchors are dealt by anchor. A task takes
   stretches it has seen in a smaller document as they are, and sorts the
   suffixes of the others, but for those that a hash of their first ``LENGTH`` bytes tells from all others: the suffix array by their first ``LENGTH`` bytes, ties in
   order of doc_id, and the array of common prefixes of neighbours. The longest
   previous factor of a suffix is the longer of its common prefixes with the previous
   and the next suffix of a smaller document (:func:`previous_factors`); windows whose
   factor reaches ``LENGTH`` go.

Stretches and windows are compared byte by byte. A task holds the distinct stretches of
one anchor, not their occurrences. Nulls: a null text is empty; a null doc_id
counts as the largest. Rows that share a doc_id aren't compared with each other.
Texts shorter than ``LENGTH`` stay whole. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, small_batches, stage, sweep, table
from ._groups import shared_keys
from ._words import BYTE, buffers, mixed, powers, slices

LENGTH = 50
GRAM = 16
LAST = (1 << 63) - 1
#: Windows that a task sorts at a time, about.
AT_ONCE = 400_000
#: Cells of the table that sets windows aside which no other can equal: two to the power of this.
TABLE_BITS = 22


def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """The stretches of a slice's rows: anchor, first and last window start, row."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(n), out=total[1:])
    low = mixed((total[gram:] - total[:-gram]) * powers(n + 1, True)[: n + 1 - gram])
    # the least of each run of grams, from runs of powers of two
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    m = len(low)
    holds = bounds[1:] - bounds[:-1] >= length
    edges = np.zeros(m + 1, np.int32)
    np.add.at(edges, bounds[:-1][holds], 1)
    np.add.at(edges, bounds[1:][holds] - length + 1, -1)
    inside = np.cumsum(edges[:m]) > 0
    new = np.ones(m, bool)
    new[1:] = low[1:] != low[:-1]
    new[bounds[:-1][holds]] = True
    first = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new | ~inside), m)
    last = stops[np.searchsorted(stops, first, "right")] - 1
    return low[first], first, last, np.searchsorted(bounds, first, "right") - 1


def _emit(batches):
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        for i, _, data, bounds in slices(batch.column("text")):
            keys, _, _, row = stretches(data, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs[i + row])], ["key", "doc"])


def _send(batches):
    """The stretches of shared anchors, with their bytes."""
    for batch in batches:
        docs, prints = batch.column("doc").to_numpy(), batch.column("fp").to_numpy()
        lists = batch.column("_keys")
        for i, _, data, bounds in slices(batch.column("text")):
            keys, first, last, row = stretches(data, bounds)
            cut = np.append(np.searchsorted(row, np.arange(len(bounds) - 1)), len(row))
            send = np.zeros(len(keys), bool)
            for k in range(len(bounds) - 1):
                a, b = cut[k], cut[k + 1]
                if b > a:
                    send[a:b] = np.isin(keys[a:b], lists[i + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
            keys, first, last, row = keys[send], first[send], last[send], row[send]
            whole = data.tobytes()
            blobs = [whole[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs[i + row]), pa.array(prints[i + row]), pa.array(first - bounds[row]), pa.array(blobs, pa.binary())], ["key", "doc", "fp", "start", "bytes"])


def previous_factors(common: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each suffix: of a suffix array in order, the bytes that each entry has in common with the
    one before it (``common``) and their documents.

    It is the longer of the common prefixes with the previous and the next entry of a smaller document, each the least of
    ``common`` on the way there. The ways are walked for all entries at once, a step over entries that are not smaller being
    as long as the way that these have walked. A way ends where less than ``length`` is common, so that factors of ``length`` and
    more are exact, and shorter ones at most what they are given as.
    """
    n = len(doc)
    best = np.zeros(n, np.int64)
    ahead = np.append(common[1:], 0) if n else common
    for step, least in ((-1, common.copy()), (1, ahead.copy())):
        at = np.arange(n) + step
        least[(at < 0) | (at >= n)] = 0
        live = np.flatnonzero(least >= length)
        live = live[doc[at[live]] >= doc[live]]
        while len(live):
            over = at[live]
            shared, there = np.minimum(least[live], least[over]), at[over]
            least[live], at[live] = shared, there
            live = live[(shared >= length) & (there >= 0) & (there < n)]
            live = live[doc[at[live]] >= doc[live]]
        found = np.flatnonzero((at >= 0) & (at < n))
        found = found[doc[at[found]] < doc[found]]
        best[found] = np.maximum(best[found], least[found])
    return best


def may_repeat(hashes: np.ndarray) -> np.ndarray:
    """The places of all hashes that occur twice or more, and few others: those that share a cell of a table with another."""
    cell = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    place = np.arange(len(cell))
    last = np.empty(1 << TABLE_BITS, np.int64)
    last[cell] = place
    several = np.zeros(1 << TABLE_BITS, bool)
    several[cell[last[cell] != place]] = True
    return np.flatnonzero(several[cell])


def repeated_windows(items: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For items (anchor, doc, stretch), of all their windows in a row: which have a previous factor of ``length`` bytes in a smaller
    document; and the first window of each item.

    Equal windows have equal anchors and equal hashes, so the suffix array leaves out windows whose hash no other one has: their
    factors are shorter, and none lies between equal windows.
    """
    sizes = np.array([len(x[2]) for x in items], np.int64)
    windows = sizes - length + 1
    data = np.frombuffer(b"".join(x[2] for x in items), np.uint8)
    begin = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) + np.repeat(np.cumsum(sizes) - sizes - begin, windows)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=total[1:])
    some = may_repeat(mixed((total[at + length] - total[at]) * powers(len(data) + 1, True)[at]))
    width = -(-length // 8)
    text = np.zeros((len(some), width * 8), np.uint8)
    text[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[at[some]]
    columns = text.view(">u8").astype(np.uint64)
    doc = np.array([x[1] for x in items], np.int64)[np.searchsorted(begin, some, "right") - 1]
    order = np.lexsort((doc, *[columns[:, k] for k in range(width - 1, -1, -1)]))
    common = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 16):
        differ = text[order[i : i + (1 << 16)]] != text[order[i - 1 : i - 1 + (1 << 16)]][: len(order) - i]
        common[i : i + (1 << 16)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    found = np.zeros(len(at), bool)
    found[some[order]] = previous_factors(common, doc[order], length) >= length
    return found, begin


def _match(batches):
    """Rows in the order of key and doc; gives the intervals to remove: doc, fp, start, stop."""
    out: list[tuple[int, int, int, int]] = []
    pending: list[tuple[int, int, bytes]] = []
    starts: list[list[tuple[int, int]]] = []
    held = 0

    def settle():
        nonlocal pending, starts, held
        found, begin = repeated_windows(pending)
        at = np.flatnonzero(found)
        item = np.searchsorted(begin, at, "right") - 1
        cut = np.append(np.flatnonzero(np.r_[len(at) > 0, (np.diff(at) > 1) | (np.diff(item) > 0)][: len(at)]), len(at))
        at -= begin[item]
        for k, a, b in zip(item[cut[:-1]].tolist(), at[cut[:-1]].tolist(), at[cut[1:] - 1].tolist()):
            for fp, s in starts[k]:
                out.append((pending[k][1], fp, s + a, s + b + LENGTH))
        pending, starts, held = [], [], 0

    def flush():
        rows = np.array(out, np.int64).reshape(-1, 4)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], ["doc", "fp", "start", "stop"])

    def group(key, seen):
        nonlocal held
        if len(seen) > 1:
            for blob, (doc, own) in seen.items():
                pending.append((key, doc, blob))
                starts.append(own)
                held += len(blob) - LENGTH + 1

    key, seen = None, {}
    for batch in batches:
        at, data = buffers(batch.column("bytes"))
        whole, at = data[at[0] : at[-1]].tobytes(), (at - at[0]).tolist()
        numbers = [batch.column(c).to_numpy().tolist() for c in ("key", "doc", "fp", "start")]
        for k, doc, fp, start, a, b in zip(*numbers, at, at[1:]):
            if k != key:
                group(key, seen)
                key, seen = k, {}
                if held > AT_ONCE:
                    settle()
            blob = whole[a:b]
            known = seen.get(blob)
            if known is None:
                seen[blob] = (doc, [(fp, start)])
            elif known[0] < doc:
                out.append((doc, fp, start, start + b - a))
            else:
                known[1].append((fp, start))
        if len(out) > 10_000:
            yield flush()
    group(key, seen)
    if pending:
        settle()
    yield flush()


def _cut(batches):
    for batch in batches:
        docs, lists = batch.column("doc_id"), batch.column("_cuts")
        cuts = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        every = lists.flatten()
        start, stop = (every.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
        for i, j, data, bounds in slices(batch.column("text")):
            own = slice(cuts[i], cuts[j])
            base = np.repeat(bounds[:-1], np.diff(cuts[i : j + 1]))
            edges = np.zeros(len(data) + 1, np.int32)
            np.add.at(edges, base + start[own], 1)
            np.add.at(edges, base + stop[own], -1)
            gone = np.cumsum(edges[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = bounds[:-1][bounds[:-1] < bounds[1:]]
            begins[heads] = gone[heads]
            removed, spans = (np.diff(np.r_[0, np.cumsum(x)][bounds]) for x in (gone, begins))
            size = np.diff(bounds)
            ends = np.r_[0, np.cumsum(size - removed)].astype(np.int64)
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([docs[i:j], *[pa.array(x.astype(np.int64)) for x in (size, removed, spans)], kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_later_copies(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    # rows that share a doc_id are told apart by a hash of their texts, all others need none
    several = stage(texts.groupBy("doc").count().where(F.col("count") > 1).select("doc", F.lit(True).alias("_several")), "ids-of-several-rows")
    told = texts.join(several, "doc", "left").withColumn("fp", F.when(F.col("_several"), F.xxhash64("text")).otherwise(0)).drop("_several")
    rows = lambda: texts.select("doc", "text").mapInArrow(_emit, "key long, doc long")
    shared = stage(shared_keys(rows()).select("key"), "anchors-shared")
    sweep(spark)
    by_doc = stage(rows().join(shared, "key").groupBy("doc").agg(F.collect_list("key").alias("_keys")), "anchors-of-docs")
    release(shared)
    sweep(spark)
    sent = told.select("doc", "fp", "text").join(by_doc, "doc").mapInArrow(_send, "key long, doc long, fp long, start long, bytes binary")
    found = sent.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_match, "doc long, fp long, start long, stop long")
    cuts = stage(found, "anchors-cuts")
    release(by_doc)
    sweep(spark)
    by_doc = cuts.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "stop")).alias("_cuts"))
    return told.join(by_doc, ["doc", "fp"], "left").select("doc_id", "text", "_cuts").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_lpf(spark, sf_dir: str) -> DataFrame:
    """Every document: its bytes, those removed, the removed runs, and the SHA-256 of what is left."""
    out = remove_later_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
