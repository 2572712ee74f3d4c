"""Chat formatting: a dialogue seen by each of its participants, in DataFrame functions only.

Speakers are the roles of a conversation other than the system's. For every
speaker the dialogue is rendered with that speaker's turns as the assistant's and all others'
as those of a user with a name; ``mask`` holds the code-point spans (end exclusive) of what is trained
on: the speaker's contents and the marks that end them.

A dialogue is rendered in blocks of turns, so that one of any length is never one value:
turns of equal ``turn div BLOCK_TURNS`` are a block, and where ties make a block larger than ``MOST`` turns it falls
apart into parts of that many, in order. Blocks in the order of ``block``, ``part`` make the dialogue.
A very long text is one value of one row.

Turns are ordered by turn, speaker, text; null turns come last. Rows that agree in
conversation, turn, role and text are one turn. A null role is the speaker ``unknown``;
a null text is empty; null conversations are one. Marks inside a text are broken by a
zero-width space. Conversations of the system alone have no perspective and empty tables none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import table

BLOCK_TURNS = 256
MOST = 1024
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS, most: int = MOST) -> DataFrame:
    """One row per conversation, speaker and block: conv_id, speaker, block, part, n_turns, n_trained, text, mask."""
    clean = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("<​|im_start|>")), F.lit(CLOSE), F.lit("<​|im_end|>"))
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
    ).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit((1 << 62)))).withColumn("h", F.xxhash64("speaker", "content"))
    sizes = rows.groupBy("conv_id", "block").count().where(F.col("count") > most).select("conv_id", F.col("block").alias("_block"), F.ceil(F.col("count") / most).alias("_parts"))
    rows = rows.join(sizes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    # only crowded blocks are ranked, by a sort that spills
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "content"))
    crowded = rows.where("_parts is not null").withColumn("part", F.lpad(F.floor((place - 1) / most).cast("string"), 12, "0"))
    rows = rows.where("_parts is null").withColumn("part", F.lit("")).unionByName(crowded)
    blocks = rows.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "speaker", "content"))).alias("turns"))
    speakers = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("me")).distinct()
    seen = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def head(t):
        return F.when(t.speaker == F.col("me"), F.lit(f"{OPEN}assistant\n")).when(t.speaker == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), clean(F.regexp_replace(t.speaker, r"\s", "_")), F.lit("\n")))

    pieces = F.transform("turns", lambda t: F.struct((t.speaker == F.col("me")).alias("mine"), head(t).alias("head"), F.concat(clean(t.content), F.lit(CLOSE)).alias("body")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))

    def step(s, p):
        a = s.at + F.length(p.head)
        b = a + F.length(p.body)
        return F.struct((b + 1).cast("long").alias("at"), F.when(p.mine, F.concat(s["mask"], F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))))).otherwise(s["mask"]).alias("mask"))

    return (
        seen.withColumn("pieces", pieces)
        .withColumn("text", F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit("\n"))), ""))
        .withColumn("mask", F.aggregate("pieces", start, step)["mask"])
        .select("conv_id", F.col("me").alias("speaker"), "block", "part", F.size("turns").cast("long").alias("n_turns"), F.size("mask").cast("long").alias("n_trained"), "text", "mask")
    )


def op1_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    """Every conversation as each of its speakers sees it; masks as text, start-end joined by commas."""
    out = perspectives(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat(m.start.cast("string"), F.lit("-"), m.end.cast("string"))), ","))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, COALESCE(role, 'unknown') AS speaker,
             replace(replace(COALESCE(text, ''), '{OPEN}', '<' || chr(8203) || '|im_start|>'), '{CLOSE}', '<' || chr(8203) || '|im_end|>') AS content
           FROM conversations),
s AS (SELECT DISTINCT conv_id, speaker AS me FROM t WHERE speaker <> '{SYSTEM}'),
p AS (SELECT t.conv_id, s.me, COALESCE(floor(t.turn / {BLOCK_TURNS})::BIGINT, 4611686018427387904) AS block, t.turn, t.speaker, t.content, t.speaker = s.me AS mine,
        CASE WHEN t.speaker = s.me THEN '{OPEN}assistant' || chr(10) WHEN t.speaker = '{SYSTEM}' THEN '{OPEN}system' || chr(10)
             ELSE '{OPEN}user name=' || regexp_replace(t.speaker, '\\s', '_', 'g') || chr(10) END AS head,
        t.content || '{CLOSE}' AS body
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, SUM(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, me, block ORDER BY turn NULLS LAST, speaker, content) AS stop FROM p)
SELECT conv_id, me AS speaker, block, '' AS part, COUNT(*) AS n_turns, COUNT(*) FILTER (mine) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, speaker, content) AS text,
       COALESCE(string_agg((stop - 1 - length(body)) || '-' || (stop - 1), ',' ORDER BY turn NULLS LAST, speaker, content) FILTER (mine), '') AS mask
FROM q GROUP BY conv_id, me, block
"""
