"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; without the setting a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shared-"))
    return _own_dir[0]


def few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``most`` (narrow) rows; else joins shuffle. Results don't depend on it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a cut in the lineage that outlives executors.

    The table goes with the session, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables (all of the process without arguments) and let Spark drop shuffle files nobody refers to."""
    paths = {t._staged_at for t in tables}
    for spark, path in list(_written):
        if tables and path not in paths:
            continue
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended, and with it the gateway
            if tables:
                raise
        _written.remove((spark, path))


def sweep(spark: SparkSession) -> None:
    """Ask for a collection in the driver's JVM; only then does Spark delete the shuffle files of dropped plans."""
    import gc
    import time

    for _ in range(2):  # what Python lets go in one round, the JVM finds in the next
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.4)


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(text: F.Column) -> F.Column:
    """The first 60 bits of MD5 as a long: the same in any SQL engine that has MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python in batches of few rows, so that very long ones don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: F.Column, body) -> F.Column:
    """``body`` of ``value``, which is worked out once per row however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)
