"""Keys shared between documents, and connected components, as DataFrame operations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import release, stage, sweep

#: Star rounds at most, and the pairs a row of the open groups may stand for before another round is worth it.
STARS = 4
PAIRS_A_ROW = 1000
#: A member of a group carries this many of its own keys before the group's.
BEFORE = 8


def shared_keys(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (key, doc): keys of two documents or more, with the smallest: key, first.

    Partial minimums and maximums: a key sends one row per task however often it occurs.
    """
    return rows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Of links ``a``, ``b``: node, component (the smallest node it reaches); nodes without links don't appear.

    Alternates the large-star and small-star steps of Kiveris et al.: each node
    moves its larger neighbours, then its smaller ones, to the smallest one it
    knows, until every link points at its component's smallest node.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most):
        # stars only: every end has one centre, and no centre is an end
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
        if not roles.groupBy("node").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre")).where("ends > 1 or (ends > 0 and centre > 0)").limit(1).count():
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        then = stage(small, "links")
        release(now)
        now = then
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def parity(key: F.Column, width: int) -> list[F.Column]:
    """Aggregates b0.. of a group's distinct 64-bit ``key``: bit i is the parity of the keys that fall to place i."""
    place = F.shiftrightunsigned(key, 64 - (64 * width - 1).bit_length())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return [F.bit_xor(F.when(F.shiftright(place, 6) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(width)]


def within(percent: int, width: int):
    """Whether two sets, told by n and maps b0.., can reach ``percent``: for :func:`link`.

    Each bit of a map is the parity of the elements that fall to it, so the maps of two sets differ in at most as many
    bits as the sets differ in elements; sets at the threshold differ in at most (n + m) * (100 - percent) / (100 + percent).
    No pair at the threshold is turned away.
    """

    def near(x, y):
        differ = functools.reduce(lambda a, b: a + b, [F.bit_count(x[f"b{k}"].bitwiseXOR(y[f"b{k}"])) for k in range(width)])
        return (100 + percent) * differ <= (100 - percent) * (x["n"] + y["n"])

    return near


def earlier(groups: DataFrame) -> DataFrame:
    """``groups`` (key, doc, fact) with ``before``, the member's last ``BEFORE`` keys before this one."""
    own = Window.partitionBy("doc", "fact").orderBy("key").rowsBetween(-BEFORE, -1)
    return groups.withColumn("before", F.collect_list("key").over(own))


def link(groups: DataFrame, verify, near, maps=None, then=None, shared=None) -> DataFrame:
    """Components (node, component) of the documents of ``groups`` (key, doc, fact) under ``verify``.

    ``verify`` takes pairs a, b and gives those that are links; ``near`` takes two facts and says whether a pair can be one.
    Facts that are too wide for all groups come later: ``maps`` takes documents (doc, fact) and gives their wide ones (doc,
    fact, wide), which ``then`` compares. In a round every document is compared with two centres of each of its groups, the
    members of least rank in two orders, unless both lie in one component already; links found make components. Rounds
    go on, with other centres, while groups that hold several components stand for very many pairs. Then the pairs of a group
    that still lie in different components are compared, as far as their facts let them be links. No pair inside a known
    component is formed, no pair that could join two is left out. ``shared`` gives the least key that two facts share, so that
    a pair of several groups is made in one of them. Without it each member carries its last ``BEFORE`` keys before the group's:
    a pair that shares one of these is left to the group of that key, so it is made where a run of shared keys begins, in the
    group of its least key in any case.
    """
    spark = groups.sparkSession
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = groups.withColumn("component", F.col("doc"))
    links = seen = found = None
    for k in range(STARS):
        rank = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "doc").alias("r"), "doc", "fact", "component"))
        centre = now.groupBy("key").agg(rank(2 * k).alias("c1"), rank(2 * k + 1).alias("c2"))
        star = (
            now.join(centre, "key")
            .select("doc", "fact", "component", F.explode(F.array("c1", "c2")).alias("c"))
            .where((F.col("component") != F.col("c.component")) & near(F.col("fact"), F.col("c.fact")))
            .select(*ends("doc", "c.doc"))
            .distinct()
        )
        star = stage(star if seen is None else star.join(seen, ["a", "b"], "left_anti"), "pairs")
        fresh = stage(verify(star), "links-found")
        seen = star if seen is None else seen.unionByName(star)
        links = fresh if links is None else links.unionByName(fresh)
        if found is None or fresh.limit(1).count():
            found = stage(components(links), "components")
        sweep(spark)
        placed = groups.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
        now = stage(placed.join(open_keys, "key").select("key", "doc", "fact", "component", "m"), "groups-open")
        sweep(spark)
        rows, pairs = now.agg(F.count(F.lit(1)), F.sum(F.col("m") - 1)).first()
        if not rows:
            return found
        now = now.drop("m")
        if pairs <= PAIRS_A_ROW * rows:
            break
    if maps:
        now = now.join(stage(maps(now.select("doc", "fact").distinct()), "facts-wide"), ["doc", "fact"])
    else:
        now, then = now.withColumn("wide", F.lit(0)), lambda x, y: F.lit(True)
    if not shared:
        now = earlier(now)
    names = [c for c in now.columns if c != "key"]
    one, other = (now.select("key", *[F.col(c).alias(f"{c}{i}") for c in names]) for i in (1, 2))
    can = (F.col("component1") < F.col("component2")) & near(F.col("fact1"), F.col("fact2")) & then(F.col("wide1"), F.col("wide2"))
    can = can & (F.col("key") == shared(F.col("fact1"), F.col("fact2")) if shared else ~F.arrays_overlap("before1", "before2"))
    rest = one.join(other, "key").where(can).select(*ends("doc1", "doc2")).distinct()
    rest = stage(rest.join(seen, ["a", "b"], "left_anti"), "pairs-rest")
    sweep(spark)
    more = stage(verify(rest), "links-more")
    return stage(components(links.unionByName(more)), "components") if more.limit(1).count() else found
