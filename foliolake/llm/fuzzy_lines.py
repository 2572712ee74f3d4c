"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are compared lower-cased and trimmed; blank ones stay. Equal lines, of any length, collapse first, by two 64-bit
hashes. A line's signature is its ``KEPT`` least hashes (a bottom-k MinHash) over character shingles of up to ``SIGNED``
characters, those that follow no ASCII letter, digit or underscore (so words begin some, and every character of other
scripts one), and of up to ``SHINGLE`` characters, those that follow ``INNER`` such characters or more (so long words, names of files, digests and addresses have
many): one rule for every line, chosen by content alone. A band is a run of ``ROWS`` neighbours in the sorted signature; signatures of at most ``TINY`` hashes also have the
runs of two, so that one odd shingle never hides them. Lines that agree in a band, and in ``SHARED`` percent of the smaller
signature, are candidates, verified by the exact Jaccard similarity of their sets of ``SHINGLE``-character shingles, at least ``PERCENT``. Union-find over the
links gives components; each keeps one line, that of the least document, in it the first place, and all its other places go.

Documents are told apart by doc_id and a hash of the text, null ids last; rows that agree in both are one document and
keep the same lines. Null texts have no lines and stay null. Band groups are reduced by partial minimums and linked through
centres, so one very common line or a large group of similar ones costs in proportion to its size. Candidates travel as
text, an eighth of their shingle hashes, which the comparison works out. Long lines
are whole: the shingle hashes of a line take about 50 bytes a character of a task's memory. Empty tables give
empty results; other columns stay as they are, n_lines and n_removed of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import let, release, stage, sweep, table
from ._groups import link, parity, within

SHINGLE = 5
SIGNED = 8
INNER = 8
PERCENT = 80
KEPT = 12
ROWS = 3
TINY = 9
#: Percentage of the smaller signature that candidates share at least; links at the threshold share about two thirds.
SHARED = 40
#: Longs of a parity map of the compared shingles.
WIDTH = 16
LAST = (1 << 63) - 1
_BLANKS = " \t\r\x0b\x0c"


def _id(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """The document's number and the hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("fp")


def _split(text) -> F.Column:
    return F.split(F.lower(text), "\n")


def _trimmed(line) -> F.Column:
    return F.trim(line, F.lit(_BLANKS))


def signature(line: F.Column) -> F.Column:
    """The least hashes of a line's shingles, sorted."""
    starts = rf"(?s)(?=((?<!\w)\S.{{0,{SIGNED - 1}}}|(?<=\w{{{INNER}}})\S.{{0,{SHINGLE - 1}}}))"
    shingles = F.regexp_extract_all(line, F.lit(starts), F.lit(1))
    return F.slice(F.sort_array(F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s)))), 1, KEPT)


def bands(low: F.Column) -> F.Column:
    """The keys of a signature."""
    none = F.array().cast("array<bigint>")

    def runs(x, rows):
        at = F.sequence(F.lit(1), F.size(x) - rows + 1)
        return F.when(F.size(x) >= rows, F.transform(at, lambda i: F.xxhash64(F.lit(rows), *[F.get(x, i + k - 1) for k in range(rows)]))).otherwise(none)

    tiny = lambda x: F.when(F.size(x) <= TINY, runs(x, 2)).otherwise(none)
    whole = lambda x: F.when(F.size(x) <= 2, F.array(F.xxhash64(F.lit(1), x))).otherwise(none)
    return let(low, lambda x: F.concat(runs(x, ROWS), tiny(x), whole(x)))


def alike(x: F.Column, y: F.Column) -> F.Column:
    """Whether two signatures share enough for their lines to be compared."""
    return 100 * F.size(F.array_intersect(x, y)) >= SHARED * F.least(F.size(x), F.size(y))


def placed_lines(docs: DataFrame) -> DataFrame:
    """doc, fp, pos, line, h, g (two hashes) of every line that isn't blank."""
    lines = docs.select(*_id(docs), F.posexplode(_split("text")).alias("pos", "line")).select("doc", "fp", "pos", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    return lines.select("doc", "fp", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def shingle_hashes(line: F.Column) -> F.Column:
    """The distinct hashes of a line's shingles, of the whole line where it is shorter; in UTF-32 a character has its place at once."""
    last = F.greatest(F.length(line) - SHINGLE, F.lit(0))
    hashes = let(F.encode(line, "UTF-32"), lambda text: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(text, 4 * i + 1, F.lit(4 * SHINGLE)))))
    return F.array_distinct(hashes)


def _reach(x: F.Column, y: F.Column) -> F.Column:
    """Whether the sets of two lines reach the threshold."""
    common = lambda x, y: let(F.size(F.array_intersect(x, y)), lambda c: 100 * c >= PERCENT * (F.size(x) + F.size(y) - c))
    return let(shingle_hashes(x), lambda x: let(shingle_hashes(y), lambda y: common(x, y)))


def fuzzy_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, fp, pos, h of every line; distinct lines h with their first place; components of their h)."""
    spark = docs.sparkSession
    lines = placed_lines(docs)
    whole = lines.groupBy("h", "g").agg(F.min(F.struct("doc", "fp", "pos")).alias("first"), F.first("line").alias("line"))
    signed = stage(whole.select("h", "first", "line", signature(F.col("line")).alias("low")), "lines-signed")
    sweep(spark)
    posted = lambda: signed.select(F.col("h").alias("doc"), F.explode(bands(F.col("low"))).alias("key"))
    keys = stage(posted().groupBy("key").count().where("count > 1").select("key"), "line-keys")
    sweep(spark)
    groups = stage(posted().join(keys, "key").join(signed.select(F.col("h").alias("doc"), F.col("low").alias("fact")), "doc"), "line-groups")
    release(keys)
    grouped = groups.select(F.col("doc").alias("h")).distinct()
    texts = stage(signed.select("h", "line").join(grouped, "h").select(F.col("h").alias("doc"), "line"), "line-texts")
    heads = stage(signed.select("h", "first"), "line-heads")
    release(signed)
    sweep(spark)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("doc").alias("b"), F.col("line").alias("y")), "b")
        return both.where(_reach(F.col("x"), F.col("y"))).select("a", "b")

    def maps(some: DataFrame) -> DataFrame:
        hashes = texts.join(some.select("doc"), "doc").select("doc", F.explode(shingle_hashes(F.col("line"))).alias("x"))
        found = hashes.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), *parity(F.col("x"), WIDTH))
        return some.join(found.select("doc", F.struct("n", *[f"b{k}" for k in range(WIDTH)]).alias("wide")), "doc")

    sizes = lambda x, y: 100 * F.least(x["n"], y["n"]) >= PERCENT * F.greatest(x["n"], y["n"])
    mapped = within(PERCENT, WIDTH)
    shared = lambda x, y: F.array_min(F.array_intersect(bands(x), bands(y)))
    found = link(groups, verify, alike, maps, lambda x, y: sizes(x, y) & mapped(x, y), shared)
    release(texts, groups)
    return lines.select("doc", "fp", "pos", "h"), heads, found


def remove_fuzzy_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that lack repeated lines, and n_lines, n_removed."""
    spark = docs.sparkSession
    lines, heads, found = fuzzy_links(docs.select("doc_id", "text"))
    placed = heads.join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    best = stage(placed.groupBy("component").agg(F.min(F.struct("first", "h")).alias("best")).select("component", F.col("best.first").alias("keeper")), "line-keepers")
    keep = placed.join(best, "component").select("h", "keeper")
    gone = lines.join(keep, "h").where("not (struct(doc, fp, pos) <=> keeper)")
    gone = stage(gone.groupBy("doc", "fp").agg(F.collect_set("pos").alias("_gone")), "lines-gone")
    sweep(spark)
    doc, fp = _id(docs)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), doc.alias("_doc"), fp.alias("_fp"))
    whole = whole.join(gone.withColumnsRenamed({"doc": "_doc", "fp": "_fp"}), ["_doc", "_fp"], "left")
    text = F.col("_row.text")
    stays = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_gone", i))
    return whole.select(
        *[(F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(stays, "\n")).alias("text") if c == "text" else F.col(f"_row.`{c}`")) for c in names],
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """Every document: its lines, those removed, and the SHA-256 of what is left."""
    out = remove_fuzzy_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
