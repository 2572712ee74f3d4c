"""Full-text search: an index of final lines that is kept as tables, phrase matching on positions, BM25, snippets.

The index holds postings (a row for each term and line, with the term's places), the lines, and their numbers by part. A part is a
hash class of documents, a bucket one of terms; postings lie in folders by bucket and part, sorted by term. A query reads the buckets of its terms
only, and of their files the row groups that hold them. When documents change, the parts they lie in are written anew; others aren't touched. One writer at a
time; a search that runs meanwhile may see a part's old rows or its new ones.

A corpus that is asked few times is better kept as its lines with their tokens (:class:`Split`): nothing is shuffled or sorted to store them, and each query is a pass over them.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udfs import snippet

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Parts and buckets of a stored index: few for small corpora, a thousand parts and some hundred buckets for large ones.
PARTS, BUCKETS = 8, 16
LINE = ("doc_id", "page", "seq")


@dataclass(frozen=True)
class Index:
    """postings: term, doc_id, page, seq, length, positions, bucket. lines: doc_id, page, seq, body, length. numbers: n, total (lines and their lengths, by part)."""

    postings: DataFrame
    lines: DataFrame
    numbers: DataFrame
    buckets: int


@dataclass(frozen=True)
class Split:
    """rows: doc_id, page, seq, body, tokens, length (:func:`index_lines`). Rows count one by one, those of the same place too."""

    rows: DataFrame

    @property
    def lines(self) -> DataFrame:
        return self.rows.select(*LINE, "body", "length")

    @property
    def numbers(self) -> DataFrame:
        return _numbers(self.rows.withColumn("part", F.lit(0)))


def index_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page, seq, body, tokens, length of the lines that have text.

    Body and tokens are worked out once a line: a generator's output isn't copied into the expressions that mention it.
    """
    body = F.explode(F.array(X.strip(F.col("body")))).alias("body")
    split = F.explode(F.array(X.tokens(F.col("body")))).alias("tokens")
    return lines.select(*LINE, body).where("body <> ''").select(*LINE, "body", split).withColumn("length", F.size("tokens"))


def occurring(rows: DataFrame) -> DataFrame:
    """term, doc_id, page, seq, length, positions (of one place each) of ``rows`` (:func:`index_lines`)."""
    return rows.select(*LINE, "length", F.posexplode("tokens").alias("at", "term")).select("term", *LINE, "length", F.array("at").alias("positions"))


def postings(places: DataFrame, *keys: str) -> DataFrame:
    """``places`` (:func:`occurring`) with all positions of a term in a line in one row; ``keys`` are columns that it is dealt by already."""
    own = places.groupBy(*keys, "term", *LINE, "length").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return own.select("term", *LINE, "length", "positions", *keys)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def in_memory(lines: DataFrame) -> Index:
    """An index that isn't stored; ``lines``: doc_id, page, seq, body."""
    rows = index_lines(lines)
    return Index(postings(occurring(rows)).withColumn("bucket", F.lit(0)), rows.select(*LINE, "body", "length"), _numbers(rows.withColumn("part", F.lit(0))), 1)


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total"))


def _store(path: str, places: DataFrame, lines: DataFrame, ids: DataFrame, buckets: int) -> None:
    """Write the parts ``ids`` (part): ``places`` and ``lines``, both with their part. One shuffle deals places to folders and gathers postings.

    Every folder of these parts gets a row without a term or document, so that what it held is replaced even where nothing is left.
    """
    none = ids.select("part", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    put = lambda rows, name, *keys: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{name}")
    full = places.withColumn("bucket", _bucket(F.col("term"), buckets)).unionByName(none, True).repartition("bucket", "part")
    put(postings(full, "bucket", "part").sortWithinPartitions("bucket", "part", "term"), "postings", "bucket", "part")
    put(ids.join(_numbers(lines), "part", "left").select("part", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "total")]).coalesce(1), "numbers", "part")
    # last, as the numbers read the old lines
    put(lines.unionByName(ids, True).repartition("part").sortWithinPartitions("part", "doc_id"), "lines", "part")


def _parted(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    return occurring(rows).withColumn("part", _part(parts)), rows.select(*LINE, "body", "length").withColumn("part", _part(parts))


def write(lines: DataFrame, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> None:
    """Index ``lines`` (doc_id, page, seq, body) as tables under ``path``."""
    spark = lines.sparkSession
    _store(path, *_parted(index_lines(lines), parts), spark.range(parts).select(F.col("id").cast("int").alias("part")), buckets)
    spark.createDataFrame([(parts, buckets)], "parts int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def open_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("postings").where("term is not null"), read("lines").where("doc_id is not null"), read("numbers"), read("layout").first()["buckets"])


def write_split(lines: DataFrame, path: str) -> None:
    """Store the tokens of ``lines`` (doc_id, page, seq, body) as a table under ``path``."""
    index_lines(lines).write.option("compression", "zstd").parquet(path)


def open_split(spark: SparkSession, path: str) -> Split:
    return Split(spark.read.parquet(path))


def terms(index: Split) -> DataFrame:
    """term, occurrences, n_lines (places that hold it). A line's terms are told apart within its row; only places of several rows need a shuffle for that."""
    both = F.posexplode(F.array("tokens", F.array_distinct("tokens"))).alias("k", "own")
    each = index.rows.select(*LINE, both).select(*LINE, "k", F.explode("own").alias("term"))
    if not index.rows.groupBy(*LINE).count().where("count > 1").limit(1).count():
        return each.groupBy("term").agg(F.count_if(F.col("k") == 0).alias("occurrences"), F.count_if(F.col("k") == 1).alias("n_lines"))
    held = each.where("k = 1").select("term", *LINE).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_lines"))
    return each.where("k = 0").groupBy("term").agg(F.count(F.lit(1)).alias("occurrences")).join(held, "term")


def replace_documents(lines: DataFrame, documents: DataFrame, path: str) -> None:
    """Put ``lines`` in place of all that the index under ``path`` has of ``documents`` (doc_id); documents without lines leave it.

    Only the new lines are split into tokens; other documents' postings in the same parts are copied.
    """
    spark = lines.sparkSession
    layout = spark.read.parquet(f"{path}/layout").first()
    gone = documents.select("doc_id").distinct()
    touched = [r[0] for r in gone.select(_part(layout["parts"]).alias("part")).distinct().collect()]  # at most ``parts`` numbers
    if not touched:
        return
    old = open_index(spark, path)
    kept = lambda rows: rows.where(F.col("part").isin(touched)).join(gone, "doc_id", "left_anti")
    made, fresh = _parted(index_lines(lines.join(gone, "doc_id", "left_semi")), layout["parts"])
    ids = spark.createDataFrame([(p,) for p in touched], "part int")
    _store(path, made.unionByName(kept(old.postings).drop("bucket")), fresh.unionByName(kept(old.lines)), ids, layout["buckets"])


def phrases_of(query: str) -> list[list[str]]:
    """Blank-separated parts of a query, each a phrase of tokens; operators mean nothing, parts without a token are left out."""
    return [t for t in map(X.plain_tokens, query.split()) if t]


def _counted(index: Split, phrases: list[list[str]]) -> DataFrame:
    """As :func:`occurrences`, with the body, of all lines; lists are gone through only where they hold a phrase's first token."""
    at = lambda i: F.get("tokens", i)

    def count(tokens):
        follows = lambda x, i: functools.reduce(lambda a, b: a & b, [at(i + k) == t for k, t in enumerate(tokens) if k], x == tokens[0])
        return F.when(F.array_contains("tokens", tokens[0]), F.size(F.filter("tokens", follows))).otherwise(0)

    return index.rows.select(*LINE, "length", *[count(p).alias(f"f{i}") for i, p in enumerate(phrases)], "body")


def occurrences(index: Index | Split, phrases: list[list[str]]) -> DataFrame:
    """doc_id, page, seq, length, f0, f1, ...: lines that hold a token of the phrases, and how often each phrase stands in them."""
    terms = sorted({t for p in phrases for t in p})
    if isinstance(index, Split) and terms:
        return _counted(index, phrases)
    if not terms:
        return index.lines.where(F.lit(False)).select(*LINE, "length")
    own = index.postings.where(F.col("bucket").isin([_bucket(F.lit(t), index.buckets) if index.buckets > 1 else F.lit(0) for t in terms]) & F.col("term").isin(terms))
    at = own.groupBy(*LINE, "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    place = lambda t: F.try_element_at(F.col("at"), F.lit(t))

    def count(tokens):
        follows = lambda i: functools.reduce(lambda a, b: a & b, [F.array_contains(place(t), i + k) for k, t in enumerate(tokens) if k], F.lit(True))
        return F.coalesce(F.size(F.filter(place(tokens[0]), follows)), F.lit(0))

    counted = at.select(*LINE, "length", *[F.greatest(count(p), F.lit(0)).alias(f"f{i}") for i, p in enumerate(phrases)])
    return counted


def matches(index: Index | Split, query: str) -> DataFrame:
    """Lines that hold every phrase, with the number of occurrences of each: f0, f1, ..."""
    phrases = phrases_of(query)
    found = occurrences(index, phrases)
    return functools.reduce(lambda rows, i: rows.where(F.col(f"f{i}") > 0), range(len(phrases)), found)


def ranked(index: Index | Split, query: str) -> DataFrame:
    """Matches with score, the lower the better, as the embedded engine ranks: phrases count as terms.

    The corpus numbers (lines, mean length, lines with each phrase) are one row, joined by a constant key.
    """
    phrases = phrases_of(query)
    found = occurrences(index, phrases)
    if not phrases:
        return found.withColumn("score", F.lit(0.0))
    one = F.lit(1).alias("_one")
    lines = index.numbers.agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("n")).alias("_mean")).select(one, "_n", "_mean")
    with_phrase = found.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"_d{i}") for i in range(len(phrases))]).select(one, "*")
    rows = matches(index, query).withColumn("_one", F.lit(1)).join(F.broadcast(lines.join(F.broadcast(with_phrase), "_one")), "_one")
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)))
        score = score - idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("length") / F.col("_mean")))
    return rows.withColumn("score", F.round(score, 4)).drop("_one")


def search(index: Index | Split, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best lines, ties in reading order, with their text, which is read for them only."""
    order = ["score", *[F.col(c).asc_nulls_last() for c in LINE]]
    found = ranked(index, query)
    if "body" in found.columns:
        return found.select(*LINE, "score", "body").orderBy(*order).offset(offset).limit(limit)
    best = found.orderBy(*order).offset(offset).limit(limit).select(*LINE, "score")
    return index.lines.join(F.broadcast(best), list(LINE)).select(*LINE, "score", "body").orderBy(*order)


def with_snippets(hits: DataFrame, query: str) -> DataFrame:
    return hits.withColumn("snippet", snippet(phrases_of(query))(F.col("body")))


def unindexed(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """Finished jobs without a line in the index."""
    return jobs.where("status = 'done'").join(index.select("doc_id").distinct(), "doc_id", "left_anti")
