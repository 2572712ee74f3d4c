"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set: it is taken in blocks of bounded size against
all documents. Texts fall into passages of ``PASSAGE`` words, half overlapping. Terms are
the benchmark's words; their passage counts come from all documents. A
randomised SVD of TF-IDF passages gives the latent space. It is fitted on every passage of
every document and the block's own: tasks sum the products of each passage's pairs of terms, these sums are
multiplied with a random matrix, the products are orthonormalised, and after
``POWERS`` rounds a small eigenproblem gives ``RANK`` directions. All of the corpus weighs as
``CORPUS_ROWS`` passages, so that a growing corpus doesn't drown the items. Every passage of every document is
projected; words outside the benchmark have no direction and count in its length. Passages whose
cosine with a benchmark passage in the latent space reaches ``COSINE``, and at least
``KNOWN`` of whose squared length (or half of whose words) is in benchmark words, are candidates; so are those that
hold ``SHORT`` consecutive words of an item, however frequent these are. Around each the
longest common subsequence of words with the whole item decides: ``SAME`` percent
of the item is contamination, and from ``PARAPHRASE`` percent on if the item's answer
(what follows its last question mark, else its last sentence) is there
too, in order, to ``SAME`` percent.

Items of fewer than ``SHORT`` words are contamination where all their words stand side by side, and only there.

Nulls: null texts and items have no words and match nothing; null doc_ids and item ids are carried. Documents are told
apart by doc_id and a hash of the text (fp), so that rows which share an id are found one by one; repeated rows give a pair
once. A very long text is one slice of a task, a few bytes a byte of text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, small_batches, stage, sweep, table
from ._words import chained, slices, word_hashes, words

PASSAGE = 32
HALF = PASSAGE // 2
RANK = 128
OVERSAMPLE = 16
POWERS = 2
#: All passages of the corpus weigh as many as this, however many they are, beside the items' own in the fit.
CORPUS_ROWS = 10_000
COSINE = 0.5
#: The least share of a passage's squared length that benchmark words must have.
KNOWN = 0.1
SAME = 80
PARAPHRASE = 50
SHORT = 8
BLOCK_BYTES = 4 << 20
#: Tasks that hold and multiply the sums over pairs of terms.
SVD_TASKS = 8
#: Terms, the most frequent ones, whose pairs a task sums in an array (64 MB); pairs with others are sent slice by slice.
DENSE = 4096
#: Cells of the matrix that a task spreads out at a time.
STRIP = 1 << 21
CELLS = ["i", "j", "value"]
#: The least weight of a term: that of one in about a third of all passages.
FLOOR = 1.0


def _tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _hashes(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def _position(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted terms, -1 for none."""
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    return np.where(terms[at] == hashes, at, -1) if len(terms) else np.full(len(hashes), -1)


class Lookup:
    """Sorted terms behind a bit table that turns most other words away."""

    def __init__(self, terms: np.ndarray, bits: int = 20):
        self.terms, self.bits = terms, np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(terms >> self.bits).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> self.bits).astype(np.int64)])
        out[some] = _position(self.terms, hashes[some])
        return out


def halves(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of rows that begin at ``first``: each word's half passage, numbered over the slice with a gap after each row; first half of each row."""
    counts = np.diff(first)
    blocks = -(-counts // HALF) + 1
    base = np.cumsum(blocks) - blocks
    row = np.repeat(np.arange(len(counts)), counts)
    return base[row] + (np.arange(first[-1]) - first[:-1][row]) // HALF, np.append(base, blocks.sum())


def passages(first: np.ndarray) -> int:
    """Passages of the rows: one for each half, the last halves alone."""
    return int((-(-np.diff(first) // HALF)).sum())


def _count_terms(terms):
    def run(batches):
        look = Lookup(terms.value)
        total = np.zeros(len(terms.value) + 1, np.int64)
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                starts, ends, first = words(data, bounds)
                at = look(word_hashes(data, starts, ends))
                half, _ = halves(first)
                some = at >= 0
                # once per half passage; a passage has two halves
                pair = np.unique(half[some] * len(total) + at[some])
                np.add.at(total, pair % len(total), 1)
                total[-1] += passages(first)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["part"])

    return run


def _add(batches):
    total = None
    for batch in batches:
        for blob in batch.column("part"):
            x = np.frombuffer(blob.as_buffer(), np.float64)
            total = x.copy() if total is None else np.add(total, x, out=total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _sum(parts: DataFrame, shape) -> np.ndarray:
    """The sum of blobs of one shape, first by a few tasks, then here: as many blobs as those tasks."""
    out = np.zeros(int(np.prod(shape)))
    for row in parts.coalesce(SVD_TASKS).mapInArrow(_add, "part binary").toLocalIterator():
        out += np.frombuffer(row.part, np.float64)
    return out.reshape(shape)


def passage_terms(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each passage (``at``: the term of each word or -1): passage, term, count, in order of both."""
    half, base = halves(first)
    begin = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
    own = half[begin]
    slots = np.full((base[-1] + 1, HALF), -1, np.int32)
    slots[half, np.arange(len(half)) - np.repeat(begin, np.diff(np.append(begin, len(half))))] = at
    both = np.concatenate((slots[own], slots[own + 1]), axis=1)
    both.sort(axis=1)
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    place = np.flatnonzero(new)
    term, count = both.ravel()[place].astype(np.int64), np.diff(np.append(place, both.size))
    some = term >= 0
    return place[some] // PASSAGE, term[some], count[some]


def _lists(i: np.ndarray, j: np.ndarray, value: np.ndarray):
    """Cells in order of i as batches of rows (i, j, value), one row for each i."""
    cut = np.append(np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)) if len(i) else np.zeros(1, np.int64)
    for k in range(0, len(cut) - 1, 512):
        own = cut[k : k + 513]
        a, offsets = own[0], pa.array((own - own[0]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[a : own[-1]])) for x in (j.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([pa.array(i[own[:-1]].astype(np.int32)), *lists], CELLS)


def _cells(terms, rank, idf, weight: float, dense: int):
    """Per task the sums over its passages of a'a, of the normalised TF-IDF row a; the cells on and under the diagonal.

    Terms go by falling frequency: cells of the first ``dense`` are summed in an array, those of others slice by slice.
    """

    def run(batches):
        look, place, w = Lookup(terms.value), rank.value, idf.value
        tri = np.arange(len(w) + 1) * np.arange(1, len(w) + 2) // 2
        total = np.zeros(tri[min(dense, len(w))])
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                starts, ends, first = words(data, bounds)
                if not len(starts):
                    continue
                at = look(word_hashes(data, starts, ends))
                row, term, a = passage_terms(np.where(at >= 0, place[at], -1), first)
                a = a * w[term]
                sizes = np.bincount(row)
                a /= np.sqrt(np.bincount(row, a * a))[row]
                begin, rest = np.cumsum(sizes) - sizes, []
                for n in np.unique(sizes[sizes > 0]).tolist():
                    take = begin[sizes == n][:, None] + np.arange(n)
                    t, x = term[take], a[take]
                    one, other = np.tril_indices(n)
                    code, value = (tri[t][:, one] + t[:, other]).ravel(), (x[:, one] * x[:, other]).ravel()
                    if t[:, -1].max() >= dense:
                        far = code >= len(total)
                        rest.append((t[:, one].ravel()[far], t[:, other].ravel()[far], value[far]))
                        code, value = code[~far], value[~far]
                    np.add.at(total, code, value)
                if rest:
                    i, j, value = (np.concatenate(x) for x in zip(*rest))
                    code, where = np.unique(i * len(w) + j, return_inverse=True)
                    yield from _lists(code // len(w), code % len(w), weight * np.bincount(where, value))
        code = np.flatnonzero(total)
        i = np.searchsorted(tri, code, "right") - 1
        yield from _lists(i, code - tri[i], weight * total[code])

    return run


def _merge(size: int):
    """Rows (i, j, value) in order of i, added up to one row for each i."""

    def run(batches):
        here, total = None, np.zeros(size)

        def done():
            j = np.flatnonzero(total)
            yield from _lists(np.full(len(j), here), j, total[j])

        for batch in batches:
            for i, j, value in zip(batch.column("i").to_pylist(), batch.column("j"), batch.column("value")):
                if i != here:
                    if here is not None:
                        yield from done()
                    here, total[:] = i, 0
                # no j twice in one row
                total[j.values.to_numpy()] += value.values.to_numpy()
        if here is not None:
            yield from done()

    return run


def gram(texts: DataFrame, items: DataFrame, terms, counts: np.ndarray, idf: np.ndarray, weight: float, dense: int = DENSE) -> DataFrame:
    """The sums of a'a over every passage of ``texts``, times ``weight``, and of ``items``: rows (i, j, value) of the cells j <= i.

    i and j are the terms' ranks by falling ``counts`` (:func:`by_frequency`). A task sums the passages of many files, so that the
    shuffle carries its cells once and not for each file: as many tasks as the cluster has cores.
    """
    context = texts.sparkSession.sparkContext
    order, rank = by_frequency(counts)
    shared = terms, context.broadcast(rank), context.broadcast(idf[order])
    schema = "i int, j array<int>, value array<double>"
    parts = texts.coalesce(max(1, context.defaultParallelism)).mapInArrow(_cells(*shared, weight, dense), schema)
    own = items.coalesce(1).mapInArrow(_cells(*shared, 1.0, dense), schema)
    return parts.unionByName(own).repartition(SVD_TASKS, "i").sortWithinPartitions("i").mapInArrow(_merge(len(idf)), schema)


def by_frequency(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms by falling count, and the rank of each term."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


def _times(basis):
    """Per task its part of the product of the symmetric matrix, of which rows have the cells j <= i, and the basis."""

    def run(batches):
        q = basis.value
        total = np.zeros(q.shape)
        for batch in batches:
            rows = max(1, STRIP // len(q))
            for k in range(0, len(batch), rows):
                part = batch.slice(k, rows)
                i, lists = part.column("i").to_numpy(), part.column("j")
                strip = np.zeros((len(part), len(q)))
                at = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                strip[at, lists.flatten().to_numpy()] = part.column("value").flatten().to_numpy()
                total[i] += strip @ q
                strip[np.arange(len(part)), i] = 0
                total += strip.T @ q[i]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def randomised_svd(cells: DataFrame, size: int, rank: int = RANK, rounds: int = POWERS, seed: int = 11) -> np.ndarray:
    """The leading right singular directions (terms x rank) of the rows whose sums a'a are ``cells`` (:func:`gram`), of ``size`` terms."""
    context = cells.sparkSession.sparkContext
    width = min(rank + OVERSAMPLE, size)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for last in [False] * rounds + [True]:
        shared = context.broadcast(basis)
        product = _sum(cells.mapInArrow(_times(shared), "part binary"), basis.shape)
        if last:
            _, u = np.linalg.eigh(basis.T @ product)
            return (basis @ u[:, ::-1])[:, : min(rank, width)]
        basis = np.linalg.qr(product)[0]


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """The length of the longest common subsequence, by bit-parallel rows."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        x = places.get(w)
        if x:
            u = v & x
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer(text: str) -> list[bytes]:
    """The words after the last question mark; without one, of the last sentence."""
    if "?" in text and text.rpartition("?")[2].strip():
        return _tokens(text.rpartition("?")[2])
    parts = [p for p in re.split(r"(?<=[.!])\s+|\n", text) if p.strip()]
    return _tokens(parts[-1]) if parts else []


def contaminated(item: list[bytes], last: list[bytes], region: list[bytes]) -> int:
    """The percentage of the item's words that the region has in order, 0 if it isn't contaminated by it."""
    share = 100 * common_subsequence(item, region) // len(item)
    if share >= SAME or (share >= PARAPHRASE and last and 100 * common_subsequence(last, region) >= SAME * len(last)):
        return share
    return 0


class Space:
    """What a task needs for one block of the benchmark."""

    def __init__(self, terms, idf, directions, items, unknown):
        self.look, self.idf, self.items, self.unknown = Lookup(terms), idf, items, unknown
        self.project = (directions * idf[:, None]).astype(np.float32)
        vectors, owner = [], []
        runs: dict[int, dict[int, set[int]]] = {}
        self.terms_of, self.longest = [], max((len(tokens) for _, tokens, _ in items), default=0)
        for k, (_, tokens, _) in enumerate(items):
            own = _hashes(tokens)
            self.terms_of.append(_position(terms, own))
            size = min(SHORT, len(tokens))
            for run in chained(own, size).tolist():
                runs.setdefault(size, {}).setdefault(run, set()).add(k)
            if size < SHORT:
                continue
            at = _position(terms, own)
            for i in range(0, max(1, len(at) - HALF), HALF):
                own = at[i : i + PASSAGE]
                vector = self.project[own].sum(axis=0)
                length = np.linalg.norm(vector)
                if length > 0:
                    vectors.append(vector / length)
                    owner.append(k)
        self.vectors = np.array(vectors, np.float32).reshape(-1, directions.shape[1])
        self.owner = np.array(owner, np.int64)
        self.runs = [(size, Lookup(np.array(sorted(own), np.uint64)), [sorted(own[run]) for run in sorted(own)]) for size, own in sorted(runs.items())]

    def copied(self, hashes, first):
        """(row, first word of the half passage, item) of the runs of words that items have too."""
        found = set()
        for size, look, items in self.runs:
            at = look(chained(hashes, size))
            hit = np.flatnonzero(at >= 0)
            row = np.searchsorted(first, hit, "right") - 1
            within = hit + size <= first[row + 1]
            hit, row = hit[within], row[within]
            word = (hit - first[row]) // HALF * HALF
            places = set(zip(row.tolist(), word.tolist(), at[hit].tolist()))
            found |= {(r, w, k) for r, w, run in places for k in items[run]}
        return found

    def candidates(self, data, bounds):
        """(row, first word of the passage, item) of a slice, its words, and the places of these among the terms."""
        starts, ends, first = words(data, bounds)
        hashes = word_hashes(data, starts, ends)
        at = self.look(hashes)
        copied = self.copied(hashes, first)
        half, base = halves(first)
        some = at >= 0
        known = np.zeros(base[-1] + 1)
        np.add.at(known, half[some], np.square(self.idf[at[some]]))
        # words outside the benchmark count in full
        total = np.bincount(half, ~some, len(known)) * self.unknown**2 + known
        ours, others = np.bincount(half, some, len(known)), np.bincount(half, ~some, len(known))
        for sums in (known, total, ours, others):
            sums[:-1] += sums[1:]
        hot = np.flatnonzero((known >= KNOWN * np.maximum(total, 1e-9)) | ((ours >= others) & (ours > 0)))
        if not len(hot) or not len(self.vectors):
            return sorted(copied), starts, ends, first, at
        hot = hot[hot < len(known) - 1]
        place = np.full(len(known) + 1, -1)
        need = np.unique(np.concatenate((hot, hot + 1)))
        place[need] = np.arange(len(need))
        take = np.flatnonzero(some)
        take = take[place[half[take]] >= 0]
        sums = np.zeros((len(need) + 1, self.project.shape[1]), np.float32)
        if len(take):
            where = place[half[take]]
            begin = np.r_[True, where[1:] != where[:-1]]
            nth = np.arange(len(take)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
            # the first words of all halves at once, then the second, and so on: no half twice in one step
            order = np.argsort(nth, kind="stable")
            for own in np.split(take[order], np.cumsum(np.bincount(nth))[:-1]):
                sums[place[half[own]]] += self.project[at[own]]
        found = []
        for i in range(0, len(hot), 4096):
            h = hot[i : i + 4096]
            vectors = sums[place[h]] + sums[place[h + 1]]
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
            p, q = np.nonzero(vectors @ self.vectors.T >= COSINE)
            row = np.searchsorted(base, h[p], "right") - 1
            found += zip(row.tolist(), ((h[p] - base[row]) * HALF).tolist(), self.owner[q].tolist())
        return sorted(copied.union(found)), starts, ends, first, at

    def matches(self, data, bounds):
        """(row, item, percentage) of a slice."""
        found, starts, ends, first, at = self.candidates(data, bounds)
        best: dict[tuple[int, int], int] = {}
        here, seen = None, np.zeros(len(self.look.terms) + 1, bool)
        for row, word, k in found:
            if best.get((row, k), 0) == 100:
                continue
            _, tokens, last = self.items[k]
            n = len(tokens)
            if n < SHORT:
                best[row, k] = 100
                continue
            if here != (row, word):
                # the words of the largest region, of which no item can have more in order than it has at all
                here = (row, word)
                seen[:] = False
                seen[at[first[row] + max(0, word - self.longest) : min(first[row + 1], first[row] + word + PASSAGE + self.longest)]] = True
                seen[-1] = False
            if 100 * int(seen[self.terms_of[k]].sum()) < PARAPHRASE * n:
                continue
            a, b = first[row] + max(0, word - n), min(first[row + 1], first[row] + word + PASSAGE + n)
            region = data[starts[a] : ends[b - 1]].tobytes().lower().split()
            share = contaminated(tokens, last, region)
            if share:
                best[row, k] = max(share, best.get((row, k), 0))
        return [(row, k, share) for (row, k), share in best.items()]


def _search(space):
    def run(batches):
        own = Space(*space.value)
        for batch in batches:
            docs, prints = batch.column("doc").to_pylist(), batch.column("fp").to_pylist()
            for i, _, data, bounds in slices(batch.column("text")):
                rows = [(docs[i + row], prints[i + row], own.items[k][0], share) for row, k, share in own.matches(data, bounds)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "fp", "item_id", "lcs_percent"])

    return run


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The items in blocks of about ``limit`` bytes; the driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        tokens = _tokens(row.text or "")
        if tokens:
            block.append((row.item_id, tokens, answer(row.text)))
            held += len(row.text)
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, fp (a hash of the text), item_id, lcs_percent of contaminated documents."""
    spark = docs.sparkSession
    context = spark.sparkContext
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("fp"), F.col("text").cast("binary").alias("text"))
    found = spark.createDataFrame([], "doc_id long, fp long, item_id long, lcs_percent long")
    for items in item_blocks(benchmark):
        terms = np.unique(np.concatenate([_hashes(tokens) for _, tokens, _ in items]))
        shared = context.broadcast(terms)
        counts = _sum(texts.select("text").mapInArrow(_count_terms(shared), "part binary"), (len(terms) + 1,))
        total = max(1.0, counts[-1])
        idf = np.maximum(FLOOR, np.log((total + 1) / (counts[:-1] + 1)))
        own = spark.createDataFrame([(b" ".join(tokens),) for _, tokens, _ in items], "text binary")
        cells = stage(gram(texts.select("text"), own, shared, counts[:-1], idf, min(1.0, CORPUS_ROWS / total)), "svd-cells")
        directions = randomised_svd(cells, len(terms))[by_frequency(counts[:-1])[1]]
        release(cells)
        space = context.broadcast((terms, idf, directions, items, float(np.log(total + 1))))
        found = found.unionByName(texts.mapInArrow(_search(space), "doc_id long, fp long, item_id long, lcs_percent long"))
        sweep(spark)
    return found.groupBy("doc_id", "fp", "item_id").agg(F.max("lcs_percent").alias("lcs_percent"))


def op6_latent_leaks(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents with the benchmark items found in them; documents without an id are a row each."""
    return by_document(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def by_document(found: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_percent: texts that share a doc_id are one document, those without one are told apart."""
    own = F.when(F.col("doc_id").isNull(), F.col("fp")).alias("_own")
    return found.groupBy("doc_id", "item_id", own).agg(F.max("lcs_percent").alias("lcs_percent")).drop("_own")
