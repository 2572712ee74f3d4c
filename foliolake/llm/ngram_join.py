"""Jaccard join of word-shingle sets by token-combination prefixes.

A document's tokens are the hashes of its distinct shingles, in one order for all documents: the rare class first, then the
frequent class, by hash inside a class. With ``n`` tokens and the threshold ``t`` a link shares at least ``ceil(t * n)`` of
them, so the first ``n - ceil(t * n) + k`` tokens, the extended prefix, hold the ``k`` first common ones; ``k`` is an eighth of
the least size of a partner. Rare tokens of the prefix are indexed alone. Frequent ones are indexed as combinations of two
neighbours, over a prefix of ``2 * d + 2 + k`` tokens, where ``d = floor((1 - t) / t * n)`` bounds the tokens that
only one of the two sets has: if not all of the ``k`` first common tokens are rare, all later common ones are
frequent, at most ``d`` odd tokens leave ``d + 1`` gaps, and so two common ones stand side by side in both sets. A document that
shares with others neither ``k`` rare tokens nor one combination links with nobody and leaves; what stays is a candidate
wherever it shares an entry.

Classes come from counters of fixed number over all tokens of all documents (the frequent ones are a bit set of
``2**COUNTER_BITS`` bits, whatever the input). Equal sets collapse first, by two 64-bit sums over their tokens. Groups of an entry
are linked through centres, and what is left is bounded by sizes and parity maps (see :mod:`._groups`), so a group of
near copies costs comparisons in proportion to its size. Every candidate is verified on whole sets.

Nulls: a null or blank text has an empty set and links with nothing; a row with a null doc_id links with nothing and has no
component. Rows that share a doc_id are one node. Repeated rows give repeated rows. A very long text is one set, 8 bytes a
word in a task. Empty tables give empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, release, small_batches, stage, sweep, table
from ._groups import link, shared_keys, within
from ._words import chained, mixed, slices, word_hashes, words

WORDS = 4
PERCENT = 85
#: The extension of a prefix: the least size of a partner over this.
EXTENDED = 8
COUNTER_BITS = 22
PAGE = 14
#: A token is frequent if its counter has this many times the mean count, and this many more.
TIMES, MORE = 4, 32
#: Longs of a parity map.
WIDTH = 8


def token_sets(data: np.ndarray, bounds: np.ndarray, k: int):
    """For each row of a slice the sorted distinct hashes of its k-word shingles; of all its words where it has fewer."""
    starts, ends, first = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    runs = chained(hashes, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            yield chained(hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64)


def _counter(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _count(k: int, bits: int, page: int):
    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                found = list(token_sets(data, bounds, k))
                if found:
                    np.add.at(total, _counter(np.concatenate(found), bits), 1)
        for p, part in enumerate(total.reshape(-1, 1 << page)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(part.astype(np.int64).tobytes(), 1)], pa.binary())], ["page", "counts"])

    return run


def _sum_pages(batches):
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, blob in zip(batch.column("page").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), np.int64)
            out[p] = out[p] + part if p in out else part
    columns = [pa.array(list(out), pa.int32()), pa.array([int(x.sum()) for x in out.values()], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in out.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["page", "total", "counts"])


def frequent_class(docs: DataFrame, k: int, bits: int = COUNTER_BITS) -> np.ndarray:
    """A bit per counter: whether its tokens are frequent. Pages of counters are summed by tasks; the driver gets a page at a time, of fixed size and number."""
    pages = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(k, bits, PAGE), "page int, counts binary")
    pages = stage(pages.repartition("page").mapInArrow(_sum_pages, "page int, total long, counts binary"), "join-counters")
    mean = (pages.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    often = np.zeros(1 << bits, bool)
    for row in pages.select("page", "counts").toLocalIterator():
        often[row.page << PAGE : (row.page + 1) << PAGE] = np.frombuffer(zlib.decompress(row.counts), np.int64) >= TIMES * mean + MORE
    if TIMES * mean + MORE <= 0:
        often[:] = True
    release(pages)
    return np.packbits(often)


def extension(n, percent: int):
    """The common tokens that the extended prefix of a set of ``n`` is sure to share with any partner."""
    return np.maximum(1, percent * n // 100 // EXTENDED)


def entries(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The index entries of one set: even for rare tokens, odd for two frequent neighbours."""
    n = len(tokens)
    k = int(extension(n, percent))
    short = min(n, n - -(-percent * n // 100) + max(1, n // EXTENDED))
    often = frequent[_counter(tokens, COUNTER_BITS)]
    rare, rest = tokens[~often], tokens[often]
    out = [rare[:short] & ~np.uint64(1)]
    if len(rare) < short:
        near = rest[: max(0, 2 * ((100 - percent) * n // percent) + 2 + k - len(rare))]
        # a set of one token has no neighbours
        out.append(mixed(near[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(near[1:])) | np.uint64(1) if n > 1 else near | np.uint64(1))
    return np.unique(np.concatenate(out))


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """``WIDTH`` longs whose bits are the parities of the tokens that fall to them."""
    bits = np.bincount((tokens & np.uint64(64 * WIDTH - 1)).astype(np.int64), minlength=64 * WIDTH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(k: int, percent: int, packed):
    def run(batches):
        frequent = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            docs = batch.column("doc")
            for i, j, data, bounds in slices(batch.column("text")):
                rows = []
                for tokens in token_sets(data, bounds, k):
                    spread = mixed(tokens + np.uint64(0x5851F42D4C957F2D))
                    sums = [int(x.sum().view(np.int64)) if len(tokens) else 0 for x in (tokens, spread)]
                    rows.append((len(tokens), *sums, entries(tokens, frequent, percent).view(np.int64), parity_map(tokens).tobytes()))
                n, s1, s2, own, maps = zip(*rows)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i), *[pa.array(x, t) for x, t in zip((n, s1, s2, own, maps), kinds)]], ["doc", "n", "s1", "s2", "entries", "map"])

    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            docs = batch.column("doc")
            for i, j, data, bounds in slices(batch.column("text")):
                blobs = [t.tobytes() for t in token_sets(data, bounds, k)]
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i), pa.array(blobs, pa.binary())], ["doc", "tokens"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked(docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    packed = spark.sparkContext.broadcast(frequent_class(texts, words_each))
    sweep(spark)
    every = stage(texts.mapInArrow(_sets(words_each, percent, packed), "doc long, n long, s1 long, s2 long, entries array<long>, map binary"), "join-sets")
    narrow = stage(every.select("doc", "n", "s1", "s2"), "join-sizes")
    full = narrow.where("n > 0 and doc is not null")
    heads = stage(full.groupBy("n", "s1", "s2").agg(F.min("doc").alias("head")), "join-heads")
    owner = heads.select("n", "s1", "s2", F.col("head").alias("doc"))
    # rows that share doc_id and set are one; those that share the doc_id alone are one node of several sets
    owned = stage(every.join(owner, ["doc", "n", "s1", "s2"], "left_semi").select("doc", "n", "entries", "map"), "join-owned")
    release(every)
    sweep(spark)
    index = lambda: owned.select("doc", "n", F.explode("entries").alias("key"))
    keys = stage(shared_keys(index().drop("n")).select("key"), "join-keys")
    sweep(spark)
    shared = stage(index().join(keys, "key").select("key", "doc", "n"), "join-shared")
    sweep(spark)
    combined = F.col("key") % 2 != 0
    able = shared.groupBy("doc", "n").agg(F.count_if(combined).alias("pairs"), F.count_if(~combined).alias("rare"))
    least = F.greatest(F.lit(1), F.expr(f"(n * {percent}) div 100 div {EXTENDED}"))
    able = stage(able.where((F.col("pairs") > 0) | (F.col("rare") >= least)).select("doc", "n"), "join-able")
    groups = stage(shared.join(able, ["doc", "n"]).select("key", "doc", "n").distinct(), "join-groups")
    release(shared, keys)
    sweep(spark)
    asked = few(able.select("doc").distinct())
    sets = stage(texts.join(asked, "doc", "left_semi").mapInArrow(_whole_sets(words_each), "doc long, tokens binary"), "join-tokens")
    sweep(spark)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long").distinct()

    def maps(some: DataFrame) -> DataFrame:
        part = lambda k: F.conv(F.hex(F.substring("map", 8 * k + 1, F.lit(8))), 16, -10).cast("long").alias(f"b{k}")
        wide = owned.select("doc", F.struct("n").alias("fact"), F.struct("n", *[part(k) for k in range(WIDTH)]).alias("wide"))
        return wide.join(some, ["doc", "fact"], "left_semi")

    sizes = lambda x, y: 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    found = link(groups.select("key", "doc", F.struct("n").alias("fact")), verify, sizes, maps, within(percent, WIDTH))
    release(owned, sets, groups)
    named = full.join(heads, ["n", "s1", "s2"]).join(found.withColumnRenamed("node", "head"), "head", "left")
    alone = narrow.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component_id"))
    out = named.select("doc", "n", F.coalesce("component", "head").alias("component_id")).unionByName(alone)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component."""
    return linked(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM t),
x AS (SELECT doc_id, UNNEST(s) AS g FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (WITH RECURSIVE reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.seen) SELECT doc_id, MIN(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, r.component_id FROM n JOIN r USING (doc_id)
"""
