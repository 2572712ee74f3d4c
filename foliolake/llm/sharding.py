"""Sharding by extendible hashing.

A document's key is a string of hash bits: 60 bits of its id's MD5, then, for
ids that repeat, bits of id and text. The directory is the set of prefixes; a
bucket splits on one more bit while it holds more bytes than a shard may, until
it fits or holds one document. The directory grows from its root: at each depth only the cells
of oversized buckets are looked at again, those of buckets that fit have left. Bucket sizes are counted over prefix cells, a
few dozen times as many as there are shards, never over documents, and partial sums meet, not cells; documents in cells
that are still too large go to another round over further bits.

Nulls: a null id hashes as the empty string, a null text has 0 bytes. A single
document above the limit has a shard of its own, and rows that agree in id and
text stay together; both are marked ``over_limit``. An empty table gives no
shards. Other columns of the input are kept, but for those of the names that
are added (shard, depth, n_bytes, shard_bytes, shard_docs, over_limit), which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import few, hash60, stage, table

SHARD_BYTES = 1 << 20
FINER = 5
STEP = 12
BITS = 60
ROUNDS = 12

_ADDED = ("_n", "_bits", "_cell", "_depth", "_at")


def _bits(h: F.Column, n: int) -> F.Column:
    return F.lpad(F.bin(h), n, "0")


def directory(keys: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """The buckets of depths low..high over ``keys`` (_bits, _n): cell (a prefix of ``high`` bits), depth, prefix, shard_bytes, shard_docs, fits.

    A cell's bucket is the shortest prefix of it that fits; where none does, the
    whole cell with ``fits`` false.
    """
    left = stage(keys.groupBy(F.substring("_bits", 1, high).alias("cell")).agg(F.sum("_n").alias("b"), F.count(F.lit(1)).alias("n")), "shard-cells")
    found = None
    for depth in range(low, high + 1):
        prefix = F.substring("cell", 1, depth).alias("prefix")
        sums = left.groupBy(prefix).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        sums = stage(sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)).coalesce(64), "shard-buckets")
        if depth < high and not sums.where("fits").limit(1).count():
            continue
        placed = left.select("cell", "b", "n", prefix).join(few(sums), "prefix")
        done = (placed if depth == high else placed.where("fits")).select("cell", F.lit(depth).alias("depth"), "prefix", "shard_bytes", "shard_docs", "fits")
        found = done if found is None else found.unionByName(done)
        if depth < high:
            if not sums.where("not fits").limit(1).count():
                break
            left = stage(placed.where("not fits").select("cell", "b", "n"), "shard-cells")
    return found


def assign(docs: DataFrame, shard_bytes: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard (its hash-prefix bits), depth, n_bytes, shard_bytes, shard_docs, over_limit."""
    own = docs.columns
    who = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_n"), _bits(hash60(who), BITS).alias("_bits"))
    total = rows.agg(F.sum("_n")).first()[0] or 0
    high = min(BITS - STEP, max(0, math.ceil(math.log2(max(1, total / shard_bytes)))) + FINER)
    low, have, done = 0, BITS, None
    for k in range(ROUNDS):
        found = stage(directory(rows.select("_bits", "_n"), shard_bytes, low, high).coalesce(64), "shard-directory")
        last = k == ROUNDS - 1
        over = 0 if last else found.where("not fits").limit(1).count()
        placed = rows.withColumn("cell", F.substring("_bits", 1, high)).join(found, "cell").drop("cell")
        out = (placed if last or not over else placed.where("fits")).select(
            "row", F.when(F.length("prefix") == 0, F.lit("*")).otherwise(F.col("prefix")).alias("shard"), "depth", F.col("_n").alias("n_bytes"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > shard_bytes).alias("over_limit")
        )
        done = out if done is None else done.unionByName(out)
        if not over:
            break
        rows = placed.where("not fits").select("row", "_n", "_bits")
        if high + STEP > have:
            have += BITS
            more = hash60(F.concat_ws(":", F.lit(str(k)), F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"row.`{text}`"), F.lit(""))))
            rows = rows.withColumn("_bits", F.concat("_bits", _bits(more, BITS)))
        low, high = high + 1, high + STEP
    return done.select(*[F.col(f"row.`{c}`") for c in own if c not in done.columns], *[c for c in done.columns if c != "row"])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def op5_extendible_shards(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS n_bytes,
         CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
c AS (SELECT x.depth, d.h >> (60 - x.depth) AS prefix, SUM(n_bytes)::BIGINT AS shard_bytes, COUNT(*) AS shard_docs
      FROM d, (SELECT UNNEST(range(0, 41))::INTEGER AS depth) x GROUP BY ALL),
f AS (SELECT d.doc_id, d.n_bytes, d.h, MIN(c.depth) AS depth FROM d JOIN c ON c.prefix = d.h >> (60 - c.depth)
      WHERE c.shard_bytes <= {SHARD_BYTES} OR c.shard_docs = 1 GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '*' ELSE substr(lpad(ltrim(bin(f.h), '0'), 60, '0'), 1, f.depth) END AS shard,
       f.depth, c.shard_bytes, c.shard_docs
FROM f JOIN c ON c.depth = f.depth AND c.prefix = f.h >> (60 - f.depth)
"""
