"""Exports as rows of text: TXT, Markdown, CSV, XML, and names of downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def bodies(pages: DataFrame) -> DataFrame:
    """``pages``: doc_id, page, lines (seq, body), text. ``bodies``: the lines' in order, of a page without lines those of its text; stubs left out."""
    ordered = F.transform(F.array_sort(F.transform("lines", lambda x: F.struct(x.seq, x.body))), lambda x: x.body)
    plain = F.split(F.regexp_replace(F.col("text"), r"(\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    own = F.when(F.size("lines") > 0, ordered).when(F.length("text") > 0, plain).otherwise(F.array().cast("array<string>"))
    return pages.withColumn("bodies", F.filter(own, lambda b: ~X.strip(b).startswith(X.STUB)))


def txt(pages: DataFrame) -> DataFrame:
    """Per document one text: a lone page is its lines, several have headings; an empty document is empty."""
    own = F.array_sort(F.collect_list(F.struct("page", "bodies")))
    each = bodies(pages).groupBy("doc_id").agg(own.alias("p"))
    part = F.transform("p", lambda x: F.concat(F.when(F.size("p") > 1, F.concat(F.lit("\n=== page "), x.page.cast("string"), F.lit(" ===\n"))).otherwise(""), F.array_join(x.bodies, "\n")))
    text = F.regexp_replace(F.array_join(part, "\n"), r"^\n+", "")
    return each.select("doc_id", F.when(text == "", "").otherwise(F.concat(text, F.lit("\n"))).alias("text"))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def markdown(pages: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("page", "bodies")))
    each = bodies(pages).groupBy("doc_id").agg(own.alias("p"))
    part = F.transform("p", lambda x: F.concat(F.lit("## Page "), x.page.cast("string"), F.lit("\n\n"), F.array_join(F.transform(x.bodies, markdown_escape), "  \n")))
    return each.select("doc_id", F.concat(F.array_join(part, "\n\n"), F.lit("\n")).alias("text"))


def csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``lines`` with row: the fields quoted where they must be. Files get a byte-order mark, a header and CRLF ends."""
    return lines.withColumn("row", F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]))


def xml_escape(text: Column) -> Column:
    out = F.regexp_replace(text, CONTROL, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml(pages: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("page", "lines")))
    each = pages.groupBy("doc_id").agg(own.alias("p"))
    line = lambda x: F.concat(F.lit('    <line seq="'), x.seq.cast("string"), F.lit('" confidence="'), F.format_string("%.4f", x.confidence), F.lit('">'), xml_escape(x.body), F.lit("</line>\n"))
    part = F.transform("p", lambda x: F.concat(F.lit('  <page number="'), x.page.cast("string"), F.lit('">\n'), F.array_join(F.transform(x.lines, line), ""), F.lit("  </page>\n")))
    return each.select("doc_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<document>\n'), F.array_join(part, ""), F.lit("</document>\n")).alias("text"))


def safe_stem(name: Column) -> Column:
    """An ASCII name for a download: every other character an underscore, none of them at the ends."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""), r"[^A-Za-z0-9_-]", "_"), r"^_+|_+$", "")
    return F.when(stem == "", "document").otherwise(stem)


def disposition(name: Column, extension: str) -> Column:
    """The header that names a download, plain and encoded."""
    full = F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(f".{extension}"))
    return F.concat(F.lit('attachment; filename="'), safe_stem(name), F.lit(f".{extension}\"; filename*=UTF-8''"), F.replace(F.url_encode(full), F.lit("+"), F.lit("%20")))


def write_csv(lines: DataFrame, columns: list[str], path: str) -> None:
    """One file per partition: byte-order mark, header, rows, CRLF."""
    head = [F.col(c).alias(f"﻿{c}" if k == 0 else c) for k, c in enumerate(columns)]
    lines.select(head).write.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)
