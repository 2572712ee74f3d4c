"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule has ``2**m`` slots; slot ``i`` lies at the van der Corput point
``bitreverse(i) / 2**m`` and belongs to the source in whose share of the
cumulative weights the point falls. A slot's rank among its source's slots is
found in closed form, digit by digit, so ranking needs no shuffle and no window
over a source. Rank ``r`` of a source is joined with block ``r mod n`` of the
source's shuffled stream, cut into blocks of equal numbers of words; the last
block is cut where the target is reached.

Nulls: a null text has no words; null sources are one source, last in order.
Empty tables give empty results; repeated rows are rows of their own; documents
without words are never taken. Columns other than ``doc_id, text, source`` are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash60, stage, table, word_count

BLOCK_WORDS = 1024
DOCS_PER_BUCKET = 1024
CHUNK = 4096


def cycle_weights(n: int = 3):
    """Weights 1..n, repeating, by the source's position."""
    return lambda position: (position % n + 1).cast("double")


def source_plan(sizes: DataFrame, weights=cycle_weights(), most: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: targets by water-filling under caps of ``most`` times the source's size.

    ``sizes``: doc_id, source, size. In ascending order of cap over weight a
    source is capped while its cap lies below the level that the sources from
    it on would share; that level rises up to the first source that isn't
    capped and falls after it, so its maximum is the level. The windows run
    over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_ratio = every.orderBy("ratio", "idx")
    full = Window.unboundedPreceding, Window.unboundedFollowing
    plan = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("idx", F.row_number().over(by_name) - 1)
        .withColumn("weight", weights(F.col("idx")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every.rowsBetween(*full)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_from"))
        .withColumn("level", F.max("level").over(every.rowsBetween(*full)))
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double")))
    )
    size, want = F.col("source_size"), F.floor(F.col("target") + 0.5)
    ceil = lambda a, b: F.floor((a + b - 1) / b).cast("long")
    return (
        plan.withColumn("want", F.least(want, F.col("cap")).cast("long"))
        .withColumn("block", F.when(size > 0, ceil(size, ceil(size, F.lit(block_words)))).otherwise(1))
        .withColumn("n_blocks", ceil(size, F.col("block")))
        .withColumn("epochs", F.when(size > 0, F.expr("want div source_size")).otherwise(0))
        .withColumn("rest", F.when(size > 0, F.col("want") % size).otherwise(0))
        .withColumn("slots", F.col("epochs") * F.col("n_blocks") + ceil(F.col("rest"), F.col("block")))
        .withColumn("slots_before", F.coalesce(F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_slots", F.sum("slots").over(every.rowsBetween(*full)))
        .withColumn("m", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("all_slots"), F.lit(1)) * 2.0))).cast("int"))
        .withColumn("lo", F.ceil(F.col("slots_before") / F.col("all_slots") * F.pow(F.lit(2.0), F.col("m"))).cast("long"))
        .withColumn("hi", F.ceil((F.col("slots_before") + F.col("slots")) / F.col("all_slots") * F.pow(F.lit(2.0), F.col("m"))).cast("long"))
        .select("idx", "source", "weight", "source_size", "n_docs", "target", "want", "block", "n_blocks", "epochs", "rest", "slots", "m", "lo", "hi")
    )


def _bitreverse(value: F.Column, m: F.Column) -> F.Column:
    return F.conv(F.reverse(F.lpad(F.bin(value), m, F.lit("0"))), 2, 10).cast("long")


def schedule(plan: DataFrame) -> DataFrame:
    """The slots: slot (its place in the mix), idx, rank, epoch, block_no, from_word, to_word within the source's stream."""
    before = lambda rev: F.expr(  # noqa: E731  slots under `slot` whose point lies under the bound with the reversed digits `rev`
        f"aggregate(sequence(1, m), 0L, (n, j) -> n + if(getbit({rev}, j - 1) = 1, greatest(0L, (slot + shiftleft(1L, j) - 1 - ({rev} & (shiftleft(1L, j - 1) - 1))) div shiftleft(1L, j)), 0L))"
    )
    whole = F.expr("shiftleft(1L, m)")
    points = (
        plan.where("slots > 0")
        .withColumn("rev_lo", _bitreverse(F.col("lo"), F.col("m")))
        .withColumn("rev_hi", F.when(F.col("hi") < whole, _bitreverse(F.col("hi"), F.col("m"))))
        .withColumn("chunk", F.explode(F.expr(f"sequence(lo, hi - 1, {CHUNK}L)")))
        .repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("idx"), F.col("chunk"))
        .withColumn("point", F.explode(F.expr(f"sequence(chunk, least(chunk + {CHUNK - 1}L, hi - 1))")))
        .withColumn("slot", _bitreverse(F.col("point"), F.col("m")))
        .withColumn("rank", F.when(F.col("rev_hi").isNull(), F.col("slot")).otherwise(before("rev_hi")) - before("rev_lo"))
        .where("rank < slots")
    )
    return (
        points.withColumn("epoch", F.expr("rank div n_blocks"))
        .withColumn("block_no", F.expr("rank % n_blocks"))
        .withColumn("from_word", F.col("block_no") * F.col("block"))
        .withColumn("to_word", F.least(F.col("from_word") + F.col("block"), F.when(F.col("epoch") == F.col("epochs"), F.col("rest")).otherwise(F.col("source_size"))))
        .select("slot", "idx", "rank", "epoch", "block_no", "from_word", "to_word")
    )


def streams(sizes: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """Each document's place in the shuffled stream of its source: row columns, idx, block, start, stop.

    Documents are dealt to buckets by their hash, more buckets the larger the
    source; prefix sums go over buckets first, then inside each bucket, so a
    source of any size spreads over all tasks.
    """
    h = hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        sizes.join(plan.select("idx", F.col("source").alias("_source"), "source_size", "n_docs", "target", "block"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("h", h)
        .withColumn("bucket", F.expr(f"shiftright(shiftright(h, 28) * ((n_docs + {DOCS_PER_BUCKET - 1}) div {DOCS_PER_BUCKET}), 32)"))
        .drop("_source", "n_docs")
    )
    past = Window.unboundedPreceding, -1
    buckets = (
        rows.groupBy("idx", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(*past)), F.lit(0)))
        .drop("words")
    )
    inside = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size", "fp").rowsBetween(*past)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets, ["idx", "bucket"])
        .withColumn("start", F.col("base") + F.col("inside"))
        .withColumn("stop", F.col("start") + F.col("size"))
        .drop("base", "inside", "h", "bucket")
    )


def mix(docs: DataFrame, weights=cycle_weights(), most: int = 3, block_words: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents in their streams, pieces of the mix).

    A piece is slot, idx, start (names the document), words: the slots in
    order, each with the words of the documents that its block holds, are the mix.
    """
    sizes = stage(docs.select("doc_id", F.xxhash64("text").alias("fp"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = stage(source_plan(sizes, weights, most, block_words).coalesce(1), "mix-plan")
    placed = stage(streams(sizes, plan, seed), "mix-streams")
    blocks = placed.where("size > 0").withColumn("block_no", F.explode(F.expr("sequence(start div block, (stop - 1) div block)")))
    pieces = (
        schedule(plan)
        .hint("merge")
        .join(blocks.select("idx", "block_no", "doc_id", "start", "stop"), ["idx", "block_no"])
        .withColumn("words", F.least("stop", "to_word") - F.greatest("start", "from_word"))
        .where("words > 0")
        .select("slot", "idx", "epoch", "doc_id", "start", "words")
    )
    return placed, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (a hash of its text), source, size, source_size, target, taken."""
    placed, pieces = mix(docs, **options)
    taken = pieces.groupBy("idx", F.col("start")).agg(F.sum("words").alias("taken"))
    some = placed.where("size > 0").join(taken, ["idx", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return some.unionByName(none).select("doc_id", "fp", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each as often as its words are taken, to the nearest whole number."""
    whole = (F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = taken_words(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).agg(F.max(whole).alias("_copies")).where("_copies > 0")
    found = docs.withColumn("_print", F.xxhash64("text")).join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp")))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
w AS (SELECT *, (idx % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap, 3 * source_size / (idx % 3 + 1)::DOUBLE AS ratio, (SELECT SUM(source_size) FROM s) AS total FROM s),
v AS (SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY ratio, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / SUM(weight) OVER (ORDER BY ratio, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w),
l AS (SELECT MAX(here) AS level FROM v),
p AS (SELECT source, source_size, COALESCE(LEAST(cap::DOUBLE, weight * level), cap::DOUBLE) AS target,
             LEAST(floor(COALESCE(LEAST(cap::DOUBLE, weight * level), cap::DOUBLE) + 0.5)::BIGINT, cap)::BIGINT AS want FROM v, l),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.want,
             COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (want // source_size) * size + GREATEST(0, LEAST(start + size, want % source_size) - start) END)::BIGINT AS taken
FROM q
"""
