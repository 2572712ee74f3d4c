"""The text filter: lines of other scripts go, sentences stay once per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def own_script(lines: DataFrame, script: X.Script) -> DataFrame:
    """Lines with text, with ``dropped`` for those of which less than half is the script's."""
    return lines.where(~X.is_blank(F.col("body"))).withColumn("dropped", F.coalesce(X.script_share(F.col("body"), script), F.lit(0.0)) < X.SHARE_LEAST)


def sentences(lines: DataFrame, order: list[str]) -> DataFrame:
    """The sentences of the lines that stay, with ``again`` for those seen before in the document.

    The window is over one document and one sentence, not over a document.
    """
    each = lines.where("not dropped").select("doc_id", *order, F.posexplode(X.sentences(F.col("body"))).alias("at", "sentence")).withColumn("key", X.strip(F.col("sentence")))
    first = Window.partitionBy("doc_id", "key").orderBy(*order, "at")
    return each.withColumn("again", (F.col("key") != "") & (F.row_number().over(first) > 1))


def clean(lines: DataFrame, order: list[str]) -> DataFrame:
    """The lines that are left, with repeated sentences taken out."""
    kept = sentences(lines, order).where("not again").groupBy("doc_id", *order).agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"))
    return kept.select("doc_id", *order, F.array_join(F.transform("s", lambda x: x.sentence), "").alias("body")).where(~X.is_blank(F.col("body")))


def totals(lines: DataFrame, order: list[str]) -> DataFrame:
    """Per document: lines dropped, sentences removed, lines kept.

    One pass: each line's sentences, or one row without a sentence for a line that is dropped, are numbered by document and sentence, then
    gathered by line and by document. A line is kept if a sentence with text stays in it.
    """
    split = F.posexplode_outer(F.when(~F.col("dropped"), X.sentences(F.col("body")))).alias("at", "sentence")
    each = lines.select("doc_id", *order, "dropped", split).select("doc_id", *order, "dropped", "at", X.strip(F.col("sentence")).alias("key"))
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(*order, "at")) == 1
    told = each.select("doc_id", *order, "dropped", (F.coalesce(F.col("key") != "", F.lit(False))).alias("text"), first.alias("first"))
    own = told.groupBy("doc_id", *order).agg(F.max("dropped").alias("dropped"), F.count_if(F.col("text") & ~F.col("first")).alias("again"), F.max(F.col("text") & F.col("first")).alias("kept"))
    return own.groupBy("doc_id").agg(F.count_if("dropped").alias("dropped"), F.sum("again").alias("repeats"), F.count_if("kept").alias("kept"))
