"""Members of archives as rows, read by a table function under budgets of files and bytes.

The function reads an archive's directory and inflates member by member. Nothing that an archive holds ends the job: a broken archive, a damaged, locked or
oddly packed member, one beyond the budgets or longer than it says is a row with its problem and without content.
"""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# What an upload may hold.
MOST_FILES, MOST_BYTES = 100, 50 * 1024 * 1024


_KINDS = {"place": T.IntegerType(), "member": T.StringType(), "hidden": T.BooleanType(), "locked": T.BooleanType(), "size": T.LongType(), "content": T.BinaryType(), "problem": T.StringType()}


@F.udtf(returnType=T.StructType([T.StructField(c, t) for c, t in _KINDS.items()]))
class _Members:
    """``content``: an archive's bytes. At most ``most_files`` members are inflated, and ``most_bytes`` as the directory counts them, in its order."""

    def eval(self, content: bytes, most_files: int, most_bytes: int):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
            yield 0, None, False, False, None, None, "archive"
            return
        total = 0
        for place, info in enumerate((i for i in archive.infolist() if not i.is_dir()), 1):
            hidden = any(p.startswith((".", "__MACOSX")) for p in info.filename.split("/"))
            locked = bool(info.flag_bits & 1)
            total += info.file_size
            problem = "locked" if locked else "files" if place > most_files else "bytes" if total > most_bytes else None
            raw = None
            if not hidden and problem is None:
                try:
                    with archive.open(info) as member:
                        raw = member.read(info.file_size + 1)
                    problem = "size" if len(raw) != info.file_size else None
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError):
                    problem = "damaged"
                except (NotImplementedError, RuntimeError):
                    problem = "packing"
            yield place, info.filename, hidden, locked, info.file_size, None if problem else raw, problem


def members(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files`` (path, content) to path, place, member, hidden, locked, size, content, problem."""
    found = files.select("path", F.col("content").alias("archive")).lateralJoin(_Members(F.col("archive").outer(), F.lit(most_files), F.lit(most_bytes)))
    return found.select("path", "place", "member", "hidden", "locked", "size", "content", "problem")


def archives(spark: SparkSession, path: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The members of all archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return members(files, most_files, most_bytes)


def archived_images(found: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The images of archives by the numbers in their names, ``most`` per archive, with their place in that order."""
    images = found.where(F.lower("member").rlike(r"\.(png|jpe?g|tiff?)$") & ~F.col("hidden") & ~F.col("locked"))
    return images.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(X.natural_key(F.col("member"))))).where(F.col("place") <= most)


def kept_as(found: DataFrame, stem: str, kind: str) -> DataFrame:
    """``found`` with target: where a reply's members are kept, null for those that aren't.

    The manifest lies among the raw files, pages under metadata among the layouts, and members of the asked ``kind`` under ``stem``, numbered from the second.
    """
    name = F.regexp_extract("member", r"[^/]+$", 0)
    page = F.col("member").rlike(r"(^|/)metadata/") & name.rlike(r"^page_.*\.json$")
    main = (name != "manifest.json") & ~page & F.lower(name).endswith(f".{kind}")
    number = F.sum(main.cast("int")).over(Window.partitionBy("path").orderBy("place"))
    folder = "json" if kind == "json" else "text"
    numbered = F.concat(F.lit(f"{folder}/{stem}"), F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), F.lit(f".{kind}"))
    return found.withColumn("target", F.when(name == "manifest.json", F.concat(F.lit("raw/"), name)).when(page, F.concat(F.lit("json/"), name)).when(main, numbered))
