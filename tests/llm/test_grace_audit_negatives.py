"""Grace deduplication, the filter audit and hard negatives against brute force on awkward tables, and on empty ones."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliolake.llm import audit, grace, negatives

from .cases import documents, empty, rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def spread(spark):
    """Shuffles keep all their partitions, so that runs cross from task to task."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# exact deduplication


def copies(spark):
    """The awkward table with copies that differ in case, non-ASCII case, and a group of a third of all rows."""
    r = random.Random(3)
    own = [(d, t) for d, t, *_ in rows()]
    own += [(1000 + k, "Hot Text " * 20 if k % 2 else "hot tExt " * 20) for k in range(90)]
    own += [(2000, "Ärger ÄÖ"), (2001, "ärger äö"), (2002, "ÄRGER ÄÖ"), (None, "hot text " * 20), (None, "only without id"), (None, "ONLY without id"), (2003, ""), (2004, "İstanbul"), (2004, "İSTANBUL"), (2004, "İstanbul")]
    r.shuffle(own)
    return own, spark.createDataFrame([(d, t, "x") for d, t in own], "doc_id long, text string, keep_id string").repartition(5)


@pytest.mark.parametrize("table_bytes", [grace.TABLE_BYTES, 3000, 40])
def test_grace_against_brute_force(spark, table_bytes):
    own, table = copies(spark)
    groups = defaultdict(list)
    for d, t in own:
        groups[(t or "").translate(FOLD)].append(d)
    wanted = Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            wanted[d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    found = grace.deduplicate(table, table_bytes).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in found) == wanted
    kept = Counter(x.text_sha256 for x in found if x.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(x.doc_id == x.keep_id for x in found if x.kept)


def test_table_compares_contents():
    own = grace.Table()
    for k in range(5000):  # two hashes only: probing must tell all of them apart
        own.add(k % 2, b"", str(k % 2500).encode(), k, 1, 1)
    assert len(own.entries) == 2500 and own.bytes == sum(len(str(k)) for k in range(2500))
    assert all(e[2:] == [int(e[1]) + 2500, 1, 2] for e in own.entries)
    assert sum(b.num_rows for b in own.spill()) == 2500 and not own.entries


def test_grace_of_nothing(spark):
    assert grace.deduplicate(empty(spark)).count() == 0


# the filter audit


def brute_audit(docs, labels):
    least = {}
    for d, t, _ in docs:
        t = t or ""
        least[t] = min(least.get(t, math.inf), math.inf if d is None else d)
    flags = defaultdict(lambda: [0, 0])
    for d, q, x in labels:
        if d is not None:
            flags[d][0] |= q == 1
            flags[d][1] |= x == 1
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^ \t-\r]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": (math.inf if d is None else d) > least[t],
        }
        parts[lang or ""].append((fails, *(flags[d] if d in flags else (0, 0))))
    out = {}
    for part, own in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = [x for x in own if not any(x[0][e] for e in order[:k])]
                here = [x for x in before if x[0][f]]
                total[f] += len(here)
                out[part, "".join(order), k + 1] = [len(before) - len(here), len(here), sum(x[0][f] for x in own) - len(here), sum(x[0][f] and sum(x[0].values()) == 1 for x in own), sum(x[1] for x in here), sum(x[2] for x in here), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return {k: tuple(int(x) for x in v) for k, v in out.items()}


def audited(spark):
    r = random.Random(9)
    docs = [(d, t, lang) for d, t, lang, *_ in rows()]
    long = " ".join(f"w{k}" for k in range(230))
    docs += [(5000 + k % 40, long, "hot") for k in range(70)] + [(None, long, "hot"), (None, long, None), (7, long, ""), (6000, "A B # " * 90, "de"), (6001, "A B # " * 90, "fr"), (6001, long + " x", "fr"), (6001, long + " x", "fr")]
    docs += [(None, "lost", "en"), (None, "lost", "de"), (None, "lost", "de")]
    r.shuffle(docs)
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d in {d for d, *_ in docs}] + [(7, 1, 1), (7, 0, 0), (123456, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda t: F.octet_length(t).cast("long") % 3, lambda t: F.lit(0).cast("long")])
def test_audit_against_brute_force(spark, spread, fingerprint):
    docs, labels = audited(spark)
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int")
    named = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, n string")
    found = audit.interactions(audit.counters(audit.masks(table, fingerprint), named)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(x.part, x.filter_order, x.step): tuple(x[c] for c in names) for x in found} == brute_audit(docs, labels)


def test_a_hot_text_is_spread_over_tasks(spark, spread):
    """Half of all rows share a text: no task gets them all, and all but the first are duplicates."""
    text = "the same again " * 100
    docs = [(k, text, "en") for k in range(3000)] + [(10_000 + k, f"other {k}", "en") for k in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(8)
    last = F.col("doc_id").asc_nulls_last()
    dealt = table.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("fp")).repartitionByRange("fp", last).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(x["count"] for x in dealt) < 1500
    found = audit.masks(table).groupBy("mask").agg(F.sum("n").alias("n")).collect()
    assert sum(x.n for x in found) == 6000
    assert sum(x.n for x in found if x["mask"] & audit.DUPLICATE) == 2999


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.counters(audit.masks(empty(spark)), labels)).count() == 0


# hard negatives


def brute_negatives(vectors):
    own = []
    for place, (vec, v, label) in enumerate(vectors):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        own.append((place, vec, label, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v]))
    out = Counter()
    for place, vec, label, v in own:
        if vec is None or vec % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if o is None else o, p, o, n == label) for p, o, n, w in own if p != place)
        for positive in [x for x in scored if x[4]][:5]:
            high = -positive[0]
            fits = [x for x in scored if not x[4] and 80 * high <= -100 * x[0] <= 100 * high][:5]
            for rank, x in enumerate(fits, 1):
                out[vec, positive[3], rank, x[3], high, -x[0]] += 1
    return out


def vectors(seed, n=700, width=9):
    r = random.Random(seed)
    hot = [r.uniform(-1, 1) for _ in range(width)]
    out = []
    for k in range(n):
        v = [struct_float(x + r.gauss(0, 0.15)) for x in hot] if k % 3 else [struct_float(x) for x in hot]
        if k % 11 == 0:
            v = [struct_float(r.uniform(-1, 1)) for _ in range(width)]
        out.append((k if k % 97 else k // 2, v, r.randrange(4)))
    out += [(None, out[5][1], 1), (800, None, 1), (801, out[6][1], None), (900, [*out[7][1][:-1], None], 2), (900, [*out[7][1][:-1], math.nan], 2), (900, [*out[7][1][:-1], math.inf], 2), (1000, out[8][1][:4], 2), (1100, [], 1), (1200, [1e30, *out[9][1][1:]], 3), (100, out[100][1], out[100][2]), (200, out[3][1], 0)]
    return out


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("table_bytes", [negatives.TABLE_BYTES, 50_000])
def test_negatives_against_brute_force(spark, table_bytes):
    own = vectors(4)
    table = spark.createDataFrame([(*x, "p") for x in own], "vec_id long, embedding array<float>, label int, place string").coalesce(1).repartition(1)
    found = negatives.mine(table, table_bytes=table_bytes).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    # repartition(1) may change the order of rows, which tells rows of one vec_id and score apart: they are equal in these columns
    assert Counter(tuple(x[c] for c in names) for x in found) == brute_negatives(own)


def test_bounds_hold_and_prune(spark):
    """No score lies outside its bounds, and most rows are not scored."""
    import numpy as np

    r = np.random.default_rng(1)
    v = np.floor(256 * r.normal(0, 0.125, (3000, 33))).astype(np.int64)
    cut = np.sort(np.quantile(v, np.linspace(0, 1, negatives.CELLS + 1), axis=0).T.astype(np.int64), axis=1)
    cut[:, 0], cut[:, -1] = v.min(axis=0), v.max(axis=0)
    low, high = negatives.tables(v[:20], cut)
    least, most = negatives.score_bounds(negatives.cells(v, cut), low, high)
    score = v @ v[:20].T
    assert (least <= score).all() and (score <= most).all()
    fifth = np.sort(least, axis=0)[-5]
    assert (most >= fifth).mean() < 0.2


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1), (100, [], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one).count() == 0
