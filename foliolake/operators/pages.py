"""Documents as pages and lines: flattening, building, scoring, review, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LINES_PER_PAGE = 20

#: The nested form of a page, as results store it.
PAGE = (
    "page int, profile string, text string, needs_review boolean, processing_ms int, ocr_engine string, ocr_fallback boolean, "
    "quality struct<blur:double,contrast:double,noise:double,skew_deg:double>, "
    "lines array<struct<id:string,seq:int,body:string,bbox:array<int>,confidence:double,layout_confidence:double,needs_review:boolean>>, "
    "corrections array<struct<before:string,after:string,tier:string,line:string,word:int>>"
)
RESULT = f"pages array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in PAGE.split(', '))}>>"


def parse_results(jobs: DataFrame, column: str = "result_json") -> DataFrame:
    """``jobs`` with ``pages``: the parsed results, empty where they are missing or broken."""
    parsed = F.from_json(column, RESULT, {"mode": "PERMISSIVE"})
    return jobs.withColumn("pages", F.coalesce(parsed["pages"], F.array().cast(f"array<struct<{RESULT.removeprefix('pages array<struct<')[:-2]}>>")))


def enrich(pages: DataFrame, script: X.Script) -> DataFrame:
    """Old pages (``lines``) in the present form: engine confidence moves to layout_confidence, the text is scored, flags are filled."""

    def line(x):
        old = x.layout_confidence.isNull()
        confidence = F.when(old, X.line_score(x.body, script)).otherwise(x.confidence)
        fresh = X.needs_review(x.body, confidence)
        return (
            x.withField("layout_confidence", F.when(old, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.confidence))).otherwise(x.layout_confidence))
            .withField("confidence", confidence)
            .withField("needs_review", F.when(old, fresh).otherwise(F.coalesce(x.needs_review, fresh)))
        )

    return pages.withColumn("lines", F.transform("lines", line))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to twice as many tasks as there are cores, if its scan has fewer tasks than the cluster has cores: scans split no row group."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores, F.xxhash64("doc_id")) if docs.rdd.getNumPartitions() < cores else docs


def document_lines(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, page, seq, body: the lines of plain texts, in pages of ``per_page``.

    Files of few row groups would leave all lines to as few tasks, so texts are dealt out first where a scan has fewer
    partitions than the cluster has cores; inputs of many files are read as they are.
    """
    docs = spread(docs.select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "body")).select(
        "doc_id", (F.floor(F.col("k") / per_page) + 1).cast("int").alias("page"), (F.col("k") % per_page + 1).alias("seq"), "body"
    )


def scored_lines(docs: DataFrame, script: X.Script) -> DataFrame:
    """The lines with confidence and needs_review."""
    # a generator's output is worked out once, however many columns mention it
    lines = document_lines(docs).select("*", F.explode(F.array(X.line_score(F.col("body"), script))).alias("confidence"))
    return lines.withColumn("needs_review", X.needs_review(F.col("body"), F.col("confidence")))


def page_review(profile, best) -> Column:
    """Whether a person must look at a page: HEAVY ones whatever their confidence, and those whose best line is below the floor or missing."""
    return F.coalesce(profile == "HEAVY", F.lit(False)) | (F.coalesce(best, F.lit(0.0)) < X.PAGE_FLOOR)


def _profile(lines: DataFrame) -> Column:
    """The page's profile, where lines carry one."""
    return F.max("profile") if "profile" in lines.columns else F.lit("FAST")


def build_pages(lines: DataFrame) -> DataFrame:
    """One row per page with its lines in order, ids, the text, and whether a person must look at it."""
    own = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("L"), F.col("seq").cast("string")).alias("id"), "body", "confidence", "needs_review")))
    pages = lines.groupBy("doc_id", "page").agg(own.alias("lines"), _profile(lines).alias("profile"))
    return pages.select(
        "doc_id",
        "page",
        "lines",
        F.array_join(F.transform("lines", lambda x: x.body), "\n").alias("text"),
        page_review(F.col("profile"), F.array_max(F.transform("lines", lambda x: x.confidence))).alias("needs_review"),
    )


def page_summaries(lines: DataFrame) -> DataFrame:
    """Per page: lines, lines for review, the best and mean confidence, needs_review; without collecting lines."""
    return lines.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("needs_review").alias("n_review"),
        F.max("confidence").alias("best"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        page_review(_profile(lines), F.max("confidence")).alias("needs_review"),
    )


def document_summaries(lines: DataFrame) -> DataFrame:
    """Per document: page_count, pages_needing_review, lines, lines for review."""
    pages = page_summaries(lines)
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("needs_review").alias("pages_needing_review"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_review").alias("lines_needing_review"),
    )


def profile(blur, contrast, noise, skew):
    """FAST pages are sharp, of good contrast, clean and straight; all others are HEAVY."""
    return F.when((blur >= 80) & (contrast >= 0.20) & (noise <= 15) & (skew <= 7), "FAST").otherwise("HEAVY")


def forced_profile(mode, routed):
    return F.when(mode == "light", "FAST").when(mode == "heavy", "HEAVY").otherwise(routed)


def repair_gate(p1, p90, p95):
    """Pages of clear contrast on white paper need no repair."""
    return F.when(((p95 - p1) / 255 >= 0.25) & (p90 >= 240), "CLEAN").otherwise("DAMAGED")


def index_percentile(values, share: float):
    """The value at place min(n - 1, int(share * n)) of the sorted values."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(share) * F.size(ordered)).cast("int")))
