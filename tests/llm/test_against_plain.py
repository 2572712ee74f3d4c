"""Searches and estimates of the corpus operators against plain versions of what they stand for, over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliolake.llm import decontamination, quality

DATA = "/root/testdata/sf0.01"


def in_order(item, text):
    """The length of the longest common subsequence."""
    row = [0] * (len(item) + 1)
    for w in text:
        before = 0
        for j, v in enumerate(item, 1):
            before, row[j] = row[j], before + 1 if v == w else max(row[j], row[j - 1])
    return row[-1]


def test_leaks_equal_a_search_of_all_documents(spark):
    """Every stretch of every document against every item: no vectors, no candidates."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    asked = [(r.item_id, r.text.lower().split(), decontamination.answer(r.text)) for r in items.collect()]
    wanted = set()
    for r in docs.select("doc_id", "text").collect():
        words = (r.text or "").lower().split()
        for item_id, own, last in asked:
            names, last = set(own), [w.decode() if isinstance(w, bytes) else w for w in last]
            at = np.flatnonzero([w in names for w in words])
            n, reach = len(own), decontamination.PASSAGE + 2 * len(own)
            # only where half of the item's words lie within reach of each other can half of them be in order
            for i in at[:: max(1, n // 8)]:
                near = words[max(0, i - reach) : i + reach]
                if 2 * len(names & set(near)) < len(names):
                    continue
                share = 100 * in_order(own, near) // n
                if share >= 80 or (share >= 50 and last and 100 * in_order(last, near) >= 80 * len(last)):
                    wanted.add((r.doc_id, item_id))
                    break
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert len(found) > 10 and found <= wanted and len(found) >= 0.95 * len(wanted), (found ^ wanted)


def test_the_latent_space_is_fitted_on_every_passage(spark):
    """The sums over pairs of terms against a plain product of all passages, and the directions against those of that product."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet").select(F.col("text").cast("binary")) for t in ("documents", "benchmark"))
    asked = [decontamination._tokens(r.text.decode()) for r in items.collect()]
    terms = np.unique(np.concatenate([decontamination._hashes(x) for x in asked]))
    place = {w: int(np.searchsorted(terms, decontamination._hashes([w])[0])) for x in asked for w in x}
    r = np.random.default_rng(3)
    counts, idf = r.integers(0, 99, len(terms)).astype(float), 1 + r.random(len(terms))

    def plain(texts, half=decontamination.HALF):
        total, found, rows = np.zeros((len(terms), len(terms))), 0, []
        for text in texts:
            tokens = (text or b"").lower().split()
            for i in range(0, len(tokens), half):
                found += 1
                row = np.zeros(len(terms))
                for w in tokens[i : i + 2 * half]:
                    if w in place:
                        row[place[w]] += idf[place[w]]
                if row.any():
                    rows.append(row / np.linalg.norm(row))
            if len(rows) > 1000:
                total, rows = total + np.array(rows).T @ np.array(rows), []
        return total + (np.array(rows).T @ np.array(rows) if rows else 0), found

    corpus, passages = plain([x.text for x in docs.collect()])
    want = 0.25 * corpus + plain([b" ".join(x) for x in asked])[0]
    order, rank = decontamination.by_frequency(counts)
    for dense in (decontamination.DENSE, 50):
        cells = decontamination.gram(docs, items, spark.sparkContext.broadcast(terms), counts, idf, 0.25, dense).cache()
        got = np.zeros_like(want)
        for x in cells.toLocalIterator():
            got[x.i, x.j] = got[x.j, x.i] = x.value
        assert passages > 10_000 and np.allclose(got[np.ix_(rank, rank)], want)
    found = decontamination.randomised_svd(cells, len(terms), rank=8, rounds=8)[rank]
    values, vectors = np.linalg.eigh(want)
    assert np.allclose(np.linalg.norm(want @ found, axis=0), values[::-1][:8], rtol=0.01)
    assert np.allclose(np.abs(found[:, 0] @ vectors[:, -1]), 1, atol=0.01)


def plain_mcd(x, r, starts=12, keep=quality.KEEP):
    """Centre, inverse and determinant of the subset of least determinant that steps from many starts settle on."""
    floors = np.diag(np.square(list(quality.FEATURES.values())))
    h, best = int(np.ceil(keep * len(x))), None
    for _ in range(starts):
        own = r.choice(len(x), 3 * quality.P, replace=False)
        for _ in range(60):
            centre, spread = x[own].mean(axis=0), np.cov(x[own].T, bias=True) + floors
            far = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread), x - centre)
            then = np.argsort(far, kind="stable")[:h]
            if set(then) == set(own):
                break
            own = then
        det = np.linalg.slogdet(spread)[1]
        if best is None or det < best[0]:
            best = det, centre, np.linalg.inv(spread)
    return best[1:]


def test_estimates_agree_with_many_starts(spark):
    r = np.random.default_rng(11)
    groups = {}
    for g, (n, bad) in {"a": (900, 0.0), "b": (700, 0.1), "c": (500, 0.2), "d": (120, 0.05)}.items():
        mix = r.normal(0, 0.3, (quality.P, quality.P)) + np.eye(quality.P) * 0.4
        x = r.normal(0, 1, (n, quality.P)) @ mix
        x[: int(bad * n)] += r.choice([-1, 1], quality.P) * 9
        groups[g] = x
    table = spark.createDataFrame([(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)], "grp string, i int, x array<double>")
    fits = quality.fit(table.select("grp", "x"))
    far = table.join(fits, "grp").select("grp", "i", (quality._distance("center", "inverse") / F.col("scale")).alias("d")).collect()
    cutoff = quality.chi_square(quality.P, 1 - quality.ALPHA)
    for g, x in groups.items():
        centre, inverse = plain_mcd(x, r)
        d2 = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        d2 /= max(1.0, np.median(d2) / quality.chi_square(quality.P, 0.5))
        mine = np.array([d for _, _, d in sorted((v.grp, v.i, v.d) for v in far if v.grp == g)])
        assert ((mine > cutoff) == (d2 > cutoff)).mean() >= 0.99, g
        assert np.corrcoef(mine, d2)[0, 1] > 0.98, g


def test_small_groups_lean_on_wider_ones(spark):
    """What is far from a language is rejected in a source of any size, what is usual isn't; a large source is judged by itself."""
    r = np.random.default_rng(5)
    rows = [("2\x1fl\x1fbig", v) for v in r.normal(0, 1, (800, quality.P))]
    rows += [(f"2\x1fl\x1fs{n}", v) for n in (1, 2, 5, 20, 60) for v in r.normal(0, 1, (n, quality.P))]
    rows += [("2\x1fl\x1fodd", v + 6) for v in r.normal(0, 1, (150, quality.P))]  # usual there only
    rows += [(g, np.full(quality.P, 15.0)) for g in ("2\x1fl\x1fs1", "2\x1fl\x1fs20", "2\x1fl\x1fbig")]
    table = spark.createDataFrame([(i, g, v.tolist()) for i, (g, v) in enumerate(rows)], "i int, grp string, x array<double>")
    scope = table.select(F.explode(F.array("grp", F.lit("1\x1fl"), F.lit("0"))).alias("grp"), "x")
    parents = spark.createDataFrame([(g, "1\x1fl") for g in {g for g, _ in rows}] + [("1\x1fl", "0"), ("0", None)], "grp string, wide string")
    found = quality.shrunk(quality.fit(scope), parents)
    far = {x.i: x.d for x in table.join(found, "grp").select("i", quality._distance("center", "inverse").alias("d")).collect()}
    cutoff = quality.chi_square(quality.P, 1 - quality.ALPHA)
    assert len(far) == len(rows) and [i for i, d in far.items() if d > cutoff] == [len(rows) - 3, len(rows) - 2, len(rows) - 1]
