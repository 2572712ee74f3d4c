"""Hard negatives by a vector-approximation file.

Each dimension is cut into 16 cells, which hold about equally many rows; a row's
approximation is its cell numbers, four bits a dimension. For an anchor, tables
give the least and the greatest share that a cell can add to the inner product,
two dimensions at a time; summed over a row's bytes they bound its score from
below and above. Only rows whose bounds let them enter an anchor's best
positives, or one of its windows of negatives, are scored exactly.

Anchors are worked on in blocks of bounded size against all rows, in two rounds:
the first finds the positives, the second the negatives in the windows that their
scores open. A task keeps, over all rows that it reads, the best few of each
anchor or window, and only these meet in the shuffle. Bounds only save work: results are
exact whatever the cells are.

Components are floor(256 * x) as integers. Rows with a null label or vector, or
a null or non-finite component, take no part; a vector without components has
score 0 with every other. Of vectors that differ in length the missing components count
as 0. Components beyond 2**27 in size count as 2**27, so that scores stay longs. Rows that repeat a vec_id are rows of their own: ties go by vec_id, nulls last, and
then in an order of the rows that is fixed within a run (rows that tie in both give equal results if their vectors are equal). A null vec_id is never an anchor. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage, table

BEST = 5
SCALE = 256
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
LOW, HIGH = 80, 100
LARGEST = 1 << 27
CELLS = 16
#: Bytes of a block's tables, which a task holds; they say how many anchors a block has.
TABLE_BYTES = 128 << 20
#: Rows and anchors whose bounds are held at a time, and pairs that are scored at a time.
ROWS_AT_ONCE, ANCHORS_AT_ONCE, PAIRS_AT_ONCE = 1024, 256, 1 << 16
NONE = (1 << 63) - 1  # stands for a null vec_id: the last among ties


def usable(vectors: DataFrame) -> DataFrame:
    """place, vec_id, label (shifted where the rule says so), v (integers)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * SCALE).cast("long"))))
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("place"), "vec_id", shifted.alias("label"), whole.alias("v"))


def edges(rows: DataFrame, width: int) -> np.ndarray:
    """Per dimension the CELLS + 1 edges of its cells, the outer ones being the least and greatest component."""
    found = np.zeros((width, CELLS + 1), np.int64)
    at = [k / CELLS for k in range(CELLS + 1)]
    for first in range(0, width, 64):
        some = range(first, min(width, first + 64))
        x = lambda d: F.coalesce(F.get("v", F.lit(d)), F.lit(0))
        row = rows.agg(*[F.percentile_approx(x(d), at, 1000).alias(f"q{d}") for d in some], *[F.min(x(d)).alias(f"l{d}") for d in some], *[F.max(x(d)).alias(f"h{d}") for d in some]).first()
        for d in some:
            found[d] = row[f"q{d}"]
            found[d, 0], found[d, -1] = row[f"l{d}"], row[f"h{d}"]
    return found


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix; missing components are 0."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    if len(values):
        row = np.repeat(np.arange(len(lists)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def cells(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The approximation of each row: a byte for two dimensions."""
    n, width = v.shape
    own = np.zeros((n, width + width % 2), np.uint8)
    for d in range(width):
        own[:, d] = np.searchsorted(bounds[d, 1:-1], v[:, d], "right")
    return own[:, ::2] | (own[:, 1::2] << 4)


def approximated(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``rows`` with their approximations: the file that the searches read."""
    width = len(bounds)

    def run(batches):
        for b in batches:
            cell = cells(padded(b.column("v"), width), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in cell], pa.binary())], [*b.schema.names, "cells"])

    return rows.mapInArrow(run, "place long, vec_id long, label long, v array<long>, cells binary")


def tables(anchors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor and byte of the approximation the least and greatest share of the score: (bytes, 256, anchors)."""
    width = len(bounds)
    ends = np.stack((bounds[:, :-1], bounds[:, 1:]))[:, :, :, None] * anchors.T[None, :, None, :]  # end, dimension, cell, anchor
    low, high = ends.min(axis=0), ends.max(axis=0)
    if width % 2:
        none = np.zeros((1, CELLS, len(anchors)), np.int64)
        low, high = np.concatenate((low, none)), np.concatenate((high, none))
    pair = lambda t: (t[1::2, :, None, :] + t[::2, None, :, :]).reshape(-1, CELLS * CELLS, len(anchors))
    return pair(low), pair(high)


def score_bounds(cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, rows by anchors, by table lookup."""
    least = np.zeros((len(cell), low.shape[2]), np.int64)
    most = least.copy()
    for k in range(cell.shape[1]):
        least += low[k][cell[:, k]]
        most += high[k][cell[:, k]]
    return least, most


def exact(a: np.ndarray, r: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row r of a with row c of b for each pair (r, c), as integers."""
    out = np.zeros(len(r), np.int64)
    for first in range(0, len(r), PAIRS_AT_ONCE):
        at = slice(first, first + PAIRS_AT_ONCE)
        out[at] = np.einsum("ij,ij->i", a[r[at]], b[c[at]])
    return out


class Best:
    """The best few (score, vec_id, place) of each of many windows, over rows that come in pieces."""

    def __init__(self, windows: int, most: int) -> None:
        self.most = most
        self.window = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.vec = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.floor = np.full(windows, np.iinfo(np.int64).min)  # the score of the last of a full window

    def add(self, window: np.ndarray, score: np.ndarray, vec: np.ndarray, place: np.ndarray) -> None:
        """Rows that can't enter may be left out: those below ``floor``."""
        if not len(window):
            return
        w, s, v, p = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.vec, vec), (self.place, place)))
        order = np.lexsort((p, v, -s, w))
        w, s, v, p = w[order], s[order], v[order], p[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        keep = rank < self.most
        self.window, self.score, self.vec, self.place = w[keep], s[keep], v[keep], p[keep]
        last = rank == self.most - 1
        self.floor[w[last]] = s[last]


def _threshold(least: np.ndarray, ok: np.ndarray, most: int) -> np.ndarray:
    """Per anchor a score that at least ``most`` rows of this piece surely reach (the least long if there are fewer)."""
    n = len(least)
    sure = np.where(ok, least, np.iinfo(np.int64).min)
    return np.partition(sure, n - most, axis=0)[n - most] if n >= most else np.full(least.shape[1], np.iinfo(np.int64).min)


class Block:
    """A block of anchors with their tables, in slices of bounded size. ``own``: place, vec_id, label and vector of each."""

    def __init__(self, own: list, bounds: np.ndarray) -> None:
        width = len(bounds)
        self.place = np.array([x[0] for x in own], np.int64)
        self.vec = np.array([x[1] for x in own], np.int64)
        self.label = np.array([x[2] for x in own], np.int64)
        self.v = np.zeros((len(own), width), np.int64)
        for i, x in enumerate(own):
            self.v[i, : len(x[3])] = x[3]
        self.bounds = bounds

    def slices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for first in range(0, len(self.place), ANCHORS_AT_ONCE):
            at = slice(first, min(len(self.place), first + ANCHORS_AT_ONCE))
            yield at, *tables(self.v[at], self.bounds)


def _pieces(batches, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for first in range(0, len(b), ROWS_AT_ONCE):
            part = b.slice(first, ROWS_AT_ONCE)
            vec = part.column("vec_id").fill_null(NONE).to_numpy()
            cell = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(len(part), -1)
            yield part.column("place").to_numpy(), vec, part.column("label").to_numpy(), padded(part.column("v"), width), cell


_FOUND = ["anchor", "window", "vec_id", "place", "score"]
_FOUND_TYPES = "anchor long, window int, vec_id long, place long, score long"


def _emit(best: Best, anchor: np.ndarray, per: int) -> Iterator[pa.RecordBatch]:
    if len(best.window):
        columns = (pa.array(anchor[best.window // per]), pa.array((best.window % per).astype(np.int32)), pa.array(best.vec), pa.array(best.place), pa.array(best.score))
        yield pa.RecordBatch.from_arrays(list(columns), _FOUND)


def search_positives(own: list, bounds: np.ndarray, most: int):
    """The best other rows of an anchor's label that a task reads."""

    def run(batches):
        block, width = Block(own, bounds), len(bounds)
        best = Best(len(block.place), most)
        cut = list(block.slices())
        for place, vec, label, v, cell in _pieces(batches, width):
            for at, low, high in cut:
                least, top = score_bounds(cell, low, high)
                ok = (label[:, None] == block.label[None, at]) & (place[:, None] != block.place[None, at])
                r, a = np.nonzero(ok & (top >= np.maximum(_threshold(least, ok, most), best.floor[at])))
                a = a + at.start
                best.add(a, exact(v, r, block.v, a), vec[r], place[r])
        yield from _emit(best, block.place, 1)

    return run


def search_negatives(own: list, windows: dict[int, list[tuple[int, int]]], bounds: np.ndarray, most: int):
    """The best rows of other labels in each window of an anchor that a task reads; ``windows``: by anchor, (rank, score) of its positives."""

    def run(batches):
        block, width = Block(own, bounds), len(bounds)
        per = max((k for w in windows.values() for k, _ in w), default=0) + 1
        # HIGH and LOW in whole numbers: LOW * s <= 100 * x <= HIGH * s
        floor = np.full((per, len(block.place)), 1, np.int64)
        ceiling = np.zeros((per, len(block.place)), np.int64)  # no score lies in [1, 0]
        for i, p in enumerate(block.place.tolist()):
            for k, s in windows.get(p, ()):
                floor[k, i], ceiling[k, i] = -(-LOW * s // 100), HIGH * s // 100
        best = Best(len(block.place) * per, most)
        cut = list(block.slices())
        for place, vec, label, v, cell in _pieces(batches, width):
            for at, low, high in cut:
                least, top = score_bounds(cell, low, high)
                other = label[:, None] != block.label[None, at]
                may = np.zeros_like(other)
                for k in range(per):
                    inside = other & (least >= floor[k, at]) & (top <= ceiling[k, at])
                    reach = np.maximum(np.maximum(_threshold(least, inside, most), best.floor[np.arange(at.start, at.stop) * per + k]), floor[k, at])
                    may |= other & (top >= reach) & (least <= ceiling[k, at]) & (floor[k, at] <= ceiling[k, at])
                r, a = np.nonzero(may)
                a = a + at.start
                score = exact(v, r, block.v, a)
                for k in range(per):
                    hit = (score >= floor[k, a]) & (score <= ceiling[k, a])
                    best.add(a[hit] * per + k, score[hit], vec[r[hit]], place[r[hit]])
        yield from _emit(best, block.place, per)

    return run


def _first(found: DataFrame, most: int) -> DataFrame:
    """The best of what the tasks found, ranked."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, most: int = BEST, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors), "vectors")
    # places are those of the written table: they don't change if a task runs again
    width = rows.agg(F.max(F.size("v"))).first()[0]
    out = None
    if width:
        bounds = edges(rows, width)
    else:
        width, bounds = 1, np.zeros((1, CELLS + 1), np.int64)
    file = stage(approximated(rows, bounds), "vector-file")
    anchors = file.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    block = max(1, table_bytes // (16 * CELLS * CELLS * (width // 2 + 1)))
    blocks = max(1, -(-anchors.count() * 5 // (4 * block)))  # places are dealt by hash, so blocks are about equal
    part = F.pmod(F.xxhash64("place"), F.lit(blocks))
    for k in range(blocks):
        own = [tuple(x) for x in anchors.where(part == k).select("place", "vec_id", "label", "v").collect()]
        if not own:
            continue
        positives = stage(_first(file.mapInArrow(search_positives(own, bounds, most), _FOUND_TYPES), most), "positives")
        windows: dict[int, list[tuple[int, int]]] = {}
        for p in positives.select("anchor", "rank", "score").collect():  # at most ``most`` an anchor of the block
            windows.setdefault(p["anchor"], []).append((p["rank"] - 1, p["score"]))
        negatives = _first(file.mapInArrow(search_negatives(own, windows, bounds, most), _FOUND_TYPES), most)
        found = negatives.select("anchor", (F.col("window") + 1).alias("window"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = positives.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        ids = spark.createDataFrame([(x[0], x[1]) for x in own], "anchor long, anchor_id long")
        real = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
        done = pairs.join(found, ["anchor", "window"]).join(F.broadcast(ids), "anchor")
        done = stage(done.select("anchor_id", real("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative_id"), "positive_score", "negative_score"), "negatives")
        out = done if out is None else out.unionByName(done)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def op11_vector_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five best positives."""
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {BEST})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) QUALIFY rank <= {BEST}
"""
