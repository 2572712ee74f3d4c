"""Quality rules: robust multivariate outliers per language and source.

Each text gives counts; transformed ratios of them form a vector. Per group of
language and source the minimum-covariance-determinant estimate is found by
concentration steps over all rows: from two starts (medians with median
deviations, and plain moments) keep the rows with the smaller distances, take
their moments, repeat; the start with the smaller determinant wins, its scale
is corrected by the median distance, and rows beyond the chi-square cutoff are
rejected. Each step is two aggregations over narrow rows with partial sums, so
a group of any size spreads over all tasks. Only a group's moments (p + p*p
numbers) meet in one place.

Every group is estimated, whatever its size, and drawn towards its language as by
``SHRINK`` rows of that, each language towards all rows: means and covariances mix by the numbers of rows, the distance of the means being part of the
spread. So a source of few rows is judged by its language, a large one by itself, and nothing changes at any one size. All rows together are drawn
towards the floors under the features' scales alone, so few rows reject nothing but what is far from all of them. Features that
hardly vary have floors under their scale. Nulls: a null text has no words and
fails; null languages and sources are groups like others. Repeated rows count
as often as they occur. Empty tables give empty results; other columns of the
input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, small_batches, stage, table

MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
#: Rows that the wider group counts for.
SHRINK = 100
KEEP = 0.75
STEPS = 4
ALPHA = 1e-7

#: Feature: its floor under the standard deviation.
FEATURES = {"word_length": 0.06, "symbols": 0.05, "dup_lines": 0.12, "repeats": 0.1, "capitals": 0.06, "marks": 0.08, "stutters": 0.1}
P = len(FEATURES)

_BLANK = bytes([32, 9, 10, 11, 12, 13])
_NOT_STARTS = bytes(range(0x80, 0xC0)) + _BLANK
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = b".,;:!?"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words, given by their hashes, inside windows of ``window`` words that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = ids[:n].copy()
    for k in range(1, window):
        h *= _MIX
        h += ids[k : n + k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks, n_stutters."""
    if not text:
        return (0,) * 9
    words = text.split()
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return len(words), len(text.translate(None, _NOT_STARTS)), without(_SYMBOLS), lines, dups, repeated_words(ids), without(_CAPITALS), without(_MARKS), int((ids[1:] == ids[:-1]).sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_stutters")


def _measure(batches):
    for b in batches:
        rows = list(zip(*map(counts, b.column("text").to_pylist()))) or [()] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), b.column("lang"), b.column("source"), *[pa.array(r, pa.int64()) for r in rows]], ["doc_id", "fp", "lang", "source", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a hash of the text), lang, source and the counts of each text."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("fp"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(_measure, "doc_id long, fp long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def vector() -> F.Column:
    """The transformed statistics; those over few words are drawn towards typical values, as they vary more."""
    n = F.col("n_words") + 20.0
    share = lambda c, per, typical: F.sqrt((F.col(c) + 20 * typical) / per)
    return F.array(
        F.log((F.col("word_chars") + 20 * 5.0) / n),
        share("n_symbols", n, 0.0),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4.0)),
        share("n_repeat_words", n, 0.0),
        share("n_capitals", n, 0.12),
        share("n_marks", n, 0.2),
        share("n_stutters", n, 0.0),
    )


def chi_square(p: int, q: float) -> float:
    """The quantile, by Wilson and Hilferty's cube."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _distance(center: str, inverse: str) -> F.Column:
    """The squared Mahalanobis distance, inside generated code."""
    d = [F.col("x")[i] - F.col(center)[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1 if i == j else 2) * F.col(inverse)[i * P + j] * d[i] * d[j]
    return total


_MOMENTS = "n double, " + ", ".join(f"s{i} double" for i in range(P)) + ", " + ", ".join(f"s{i}_{j} double" for i in range(P) for j in range(i, P))


def _moments() -> list[F.Column]:
    x = F.col("x")
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]]


_FIT = "grp string, start int, center array<double>, inverse array<double>, log_det double"


def _solve(frames):
    """Moments of each group and start to center, inverse and determinant; the floors keep any group regular."""
    import pandas as pd

    floors = np.diag(np.square(list(FEATURES.values())))
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            mean = np.array([getattr(r, f"s{i}") for i in range(P)]) / r.n
            cov = np.empty((P, P))
            for i in range(P):
                for j in range(i, P):
                    cov[i, j] = cov[j, i] = getattr(r, f"s{i}_{j}") / r.n - mean[i] * mean[j]
            cov += floors
            out.append((r.grp, r.start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["grp", "start", "center", "inverse", "log_det"])


def fit(rows: DataFrame, steps: int = STEPS, keep: float = KEEP) -> DataFrame:
    """``rows``: grp, x. Per group: center, inverse, scale, the estimate of minimum determinant."""
    medians = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], 0.5, 1000).alias(f"m{i}") for i in range(P)])
    # a group's estimate is a row: rows stay where they are while there aren't very many groups
    spread = rows.join(few(stage(medians, "mcd-medians")), "grp").groupBy("grp").agg(
        F.lit(0).alias("start"),
        F.array(*[F.first(f"m{i}") for i in range(P)]).alias("center"),
        F.array(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col(f"m{i}")), 0.5, 1000) * 1.4826 for i in range(P)]).alias("sd"),
    )
    floors = F.array(*[F.lit(v) for v in FEATURES.values()])
    diagonal = F.array(*[1 / (F.col("sd")[i] * F.col("sd")[i] + floors[i] * floors[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    first = spread.select("grp", "start", "center", diagonal.alias("inverse"), F.lit(0.0).alias("log_det"))
    second = rows.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(1)).mapInPandas(_solve, _FIT)
    state = stage(first.unionByName(second), "mcd-start")
    for _ in range(steps):
        far = rows.join(few(state), "grp").select("grp", "start", "x", _distance("center", "inverse").alias("d2"))
        bound = far.groupBy("grp", "start").agg(F.percentile_approx("d2", keep, 1000).alias("bound"))
        inner = far.join(few(stage(bound, "mcd-bound")), ["grp", "start"]).where("d2 <= bound")
        state = stage(inner.groupBy("grp", "start").agg(*_moments()).mapInPandas(_solve, _FIT), "mcd-step")
    best = state.groupBy("grp").agg(F.min_by(F.struct("center", "inverse"), F.struct("log_det", "start")).alias("b")).select("grp", "b.*")
    best = stage(best, "mcd-best")
    scale = F.greatest(F.lit(1.0), F.percentile_approx(_distance("center", "inverse"), 0.5, 1000) / chi_square(P, 0.5)).alias("scale")
    return stage(best.join(rows.join(few(best), "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), scale), "grp"), "mcd-fit")


_SHRUNK = "grp string, center array<double>, inverse array<double>, spread array<double>"


def _mix(weight: float):
    """Estimates (center, inverse, scale, n) and those of their wider groups (wide_center, wide_spread; null for the widest) to shrunk ones."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                centre, spread = np.array(r.center), np.linalg.inv(np.array(r.inverse).reshape(P, P)) * r.scale
                if r.wide_center is not None:
                    w, wide = r.n / (r.n + weight), np.array(r.wide_center)
                    apart = centre - wide
                    spread = w * spread + (1 - w) * np.array(r.wide_spread).reshape(P, P) + w * (1 - w) * np.outer(apart, apart)
                    centre = wide + w * apart
                out.append((r.grp, centre.tolist(), np.linalg.inv(spread).ravel().tolist(), spread.ravel().tolist()))
            yield pd.DataFrame(out, columns=["grp", "center", "inverse", "spread"])

    return run


def shrunk(estimates: DataFrame, parents: DataFrame, weight: float = SHRINK) -> DataFrame:
    """``estimates`` (:func:`fit`) of three depths, each drawn towards its wider group's. ``parents``: grp, wide (null for the widest)."""
    known, done = parents.join(few(estimates), "grp"), None
    for depth in ("0", "1", "2"):
        own = known.where(F.col("grp").startswith(depth))
        if done is None:
            wide = own.withColumns({"wide_center": F.lit(None).cast("array<double>"), "wide_spread": F.lit(None).cast("array<double>")})
        else:
            wide = own.join(few(done.select(F.col("grp").alias("wide"), F.col("center").alias("wide_center"), F.col("spread").alias("wide_spread"))), "wide")
        found = stage(wide.select("grp", "center", "inverse", "scale", "n", "wide_center", "wide_spread").mapInPandas(_mix(weight), _SHRUNK), "mcd-shrunk")
        done = found
    return done.select("grp", "center", "inverse")


def judge(docs: DataFrame, weight: float = SHRINK, alpha: float = ALPHA) -> DataFrame:
    """The counts of every document, base_failed, distance (null where nothing could be estimated) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    key = lambda *c: F.concat_ws("\x1f", F.lit(str(len(c))), *[F.coalesce(x, F.lit("\x00")) for x in c])
    rows = measure(docs).withColumn("base_failed", failed).withColumn("x", vector())
    rows = rows.withColumn("grp", key(F.col("lang"), F.col("source"))).withColumn("by_lang", key(F.col("lang")))
    rows = stage(rows, "quality-counts")
    fitted = rows.where("not base_failed")
    scope = fitted.select(F.explode(F.array("grp", "by_lang", F.lit("0"))).alias("grp"), "x")
    wider = F.explode(F.array(F.struct("grp", F.col("by_lang").alias("wide")), F.struct(F.col("by_lang").alias("grp"), F.lit("0").alias("wide")), F.struct(F.lit("0").alias("grp"), F.lit(None).cast("string").alias("wide"))))
    parents = stage(fitted.select("grp", "by_lang").distinct().select(wider.alias("p")).select("p.*").distinct(), "quality-groups")
    estimates = shrunk(fit(scope), parents, weight)
    cutoff = chi_square(P, 1 - alpha)
    return rows.join(few(estimates), "grp", "left").withColumn("distance", _distance("center", "inverse")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff))
    ).select("doc_id", "fp", "lang", "source", *_COUNTS, "base_failed", "distance", "kept")


def op8_robust_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
