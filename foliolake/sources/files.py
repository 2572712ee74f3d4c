"""Sources: scans and archives as binary files, recognised layouts, saved corrections, uploads.

Everything is read by Spark's own readers, so paths may lie in any store they know.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.layout import BLOCKS

# What may be uploaded, and how much.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf"}
MOST_BYTES, MOST_FILES, MOST_PDF_PAGES = 50 * 1024 * 1024, 100, 25


def masters(spark: SparkSession, path: str) -> DataFrame:
    """job_id, page order, path, length, content of stored masters: one alone first, numbered ones by number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "master*").load(path)
    number = F.try_to_number(F.regexp_extract("path", r"master-(\d+)\.[^./]+$", 1), F.lit("999999999")).cast("int")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("job_id"), F.coalesce(number, F.lit(0)).alias("ord"), "path", "length", "content").orderBy("job_id", "ord")


def verified(files: DataFrame, digest: str) -> DataFrame:
    """``files`` with whether their content still has its digest."""
    return files.withColumn("verified", F.sha2("content", 256) == F.col(digest))


def pages_in(content: bytes | None) -> int | None:
    """Pages of an image or document by its header and directory; null for anything else."""
    if not content:
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n" or content[:3] == b"\xff\xd8\xff":
        return 1
    if content[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if content[:2] == b"II" else ">"
        at, seen = struct.unpack(order + "I", content[4:8])[0], set()
        while at and at not in seen and at + 2 <= len(content):
            seen.add(at)
            entries = struct.unpack(order + "H", content[at : at + 2])[0]
            end = at + 2 + 12 * entries
            if end + 4 > len(content):
                break
            at = struct.unpack(order + "I", content[end : end + 4])[0]
        return len(seen) or None
    if content[:5] == b"%PDF-":
        return len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", content)) or None
    return None


def _probe(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pages_in(x) for x in b.column("content").to_pylist()], pa.int32())], [*b.schema.names, "pages"])


def probed(files: DataFrame) -> DataFrame:
    """``files`` with pages, null where the content can't be read."""
    return files.mapInArrow(_probe, T.StructType([*files.schema.fields, T.StructField("pages", T.IntegerType())]))


def kind(member: Column) -> Column:
    """Where an archive's member is kept."""
    name = F.lower(member)
    return F.when(name.endswith(".json"), "json").when(name.rlike(r"\.(txt|md|html?)$"), "text").otherwise("raw")


def layouts(members: DataFrame) -> DataFrame:
    """The parsed first page file (by name) of each archive."""
    own = members.where(F.col("member").rlike(r"metadata/page_[^/]*\.json$")).groupBy("path").agg(F.min_by("content", "member").alias("content"))
    return own.select("path", F.from_json(F.col("content").cast("string"), BLOCKS, {"mode": "PERMISSIVE"}).alias("p")).select("path", "p.*")


SAVED = "corrections array<struct<page:string,line:string,word:string,before:string,after:string>>, updated_at string"


def saved_corrections(files: DataFrame) -> DataFrame:
    """``files``: job_id, json. One row per job: corrections (the good ones, in order), skipped, problem.

    No file is no problem; text that is no object with a list of corrections is one; bad entries are left out and counted.
    """
    parsed = F.from_json("json", SAVED, {"mode": "PERMISSIVE"})
    broken = F.col("json").isNotNull() & (F.col("p").isNull() | F.col("p.corrections").isNull())
    whole = lambda c: c.try_cast("int")
    good = F.filter("p.corrections", lambda c: (whole(c.page) >= 1) & (whole(c.word) >= 1) & (F.length(c.line).between(1, 32)) & (X.strip(c.after) != "") & (F.length(c.after) <= 256))
    shaped = F.transform(good, lambda c, i: F.struct((i + 1).alias("pos"), whole(c.page).alias("page"), c.line.alias("line"), whole(c.word).alias("word"), c.before.alias("before"), c.after.alias("after")))
    out = files.withColumn("p", parsed).withColumn("_good", F.coalesce(shaped, F.array().cast("array<struct<pos:int,page:int,line:string,word:int,before:string,after:string>>")))
    skipped = F.coalesce(F.size("p.corrections") - F.size("_good"), F.lit(0))
    problem = F.when(broken, "unreadable").when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" bad entries skipped")))
    return out.select("job_id", F.col("_good").alias("corrections"), skipped.alias("skipped"), problem.alias("problem"))


def upload_problem(name: Column, mime: Column, size: Column, files: Column) -> Column:
    """Why an upload is refused; null if it isn't: type and extension must agree, several files may not hold documents."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    expected = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), extension)
    return (
        F.when(expected.isNull(), "extension")
        .when(expected != F.lower(mime), "type")
        .when((files > 1) & (extension == "pdf"), "document among images")
        .when(files > MOST_FILES, "files")
        .when(size > MOST_BYTES, "size")
        .when(size <= 0, "empty")
    )


def model_reply(text: Column, schema: str) -> Column:
    """The object in a model's reply, bare or among other text; null without one."""
    plain = F.from_json(F.trim(text), schema, {"mode": "PERMISSIVE"})
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.trim(text).startswith("{"), plain).otherwise(F.from_json(F.when(inner != "", inner), schema, {"mode": "PERMISSIVE"}))
