"""Texts into units: transcripts, paragraphs, pages, sections; units into canonical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tagged lines of transcripts, page marks.
TAGGED = r"^\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s+([^:]{1,80}):\s+(.*)$"
PAGE = r"(?m)^--- Page (\d+) ---$"


def lines(text: Column) -> Column:
    """Lines that hold something."""
    return F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")


def tagged_share(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(lines(text), lambda x: x.rlike(TAGGED))), F.size(lines(text))), F.lit(0.0))


def transcript_units(df: DataFrame, text: str = "text") -> DataFrame:
    """Units of transcripts: a line each where at least half are tagged, else a paragraph each."""
    tagged = df.where(tagged_share(F.col(text)) >= 0.5).select("*", F.posexplode(lines(F.col(text))).alias("pos", "unit"))
    one = lambda k: F.when(F.col("unit").rlike(TAGGED), F.regexp_extract("unit", TAGGED, k))
    tagged = tagged.select(*df.columns, F.format_string("turn-%04d", F.col("pos") + 1).alias("unit_key"), one(2).alias("speaker"), F.coalesce(one(3), F.col("unit")).alias("content"), F.when(~F.col("unit").rlike(TAGGED), "untagged_line").alias("flag"))
    plain = df.where(tagged_share(F.col(text)) < 0.5).select("*", F.posexplode(F.filter(F.split(F.col(text), r"\n\s*\n"), lambda x: F.trim(x) != "")).alias("pos", "unit"))
    plain = plain.select(*df.columns, F.format_string("para-%04d", F.col("pos") + 1).alias("unit_key"), F.lit(None).cast("string").alias("speaker"), F.col("unit").alias("content"), F.lit("speaker_attribution=unavailable").alias("flag"))
    return tagged.unionByName(plain)


def pages(df: DataFrame, text: str = "text") -> DataFrame:
    """A unit for each page between page marks; a text without marks is one unit ``whole``."""
    pieces, numbers = F.split(F.col(text), PAGE), F.regexp_extract_all(F.col(text), F.lit(PAGE), F.lit(1))
    marked = df.where(F.size(numbers) > 0).select(*df.columns, F.explode(F.arrays_zip(F.slice(pieces, F.lit(2), F.size(numbers)).alias("body"), numbers.alias("number"))).alias("p"))
    marked = marked.select(*df.columns, F.format_string("page-%04d", F.col("p.number").cast("int")).alias("unit_key"), F.trim(F.regexp_replace("p.body", r"^\n|\n\z", "")).alias("content"))
    rest = df.where(F.size(numbers) == 0).select(*df.columns, F.lit("whole").alias("unit_key"), F.col(text).alias("content"))
    return marked.unionByName(rest)


def html_sections(df: DataFrame, html: str = "html") -> DataFrame:
    """Headings h1 to h6 of a page with their number and level, and the paragraphs below each."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(h[1-6]|p)[^>]*>(.*?)</\1>"), F.lit(0))
    rows = df.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    name = F.lower(F.regexp_extract("block", r"(?is)^<(h[1-6]|p)", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace("block", "<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("page_id", "pos", name.alias("tag"), body.alias("body"))
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"section": F.sum((F.col("tag") != "p").cast("int")).over(order), "title": F.last(F.when(F.col("tag") != "p", F.col("body")), ignorenulls=True).over(order)})
    return rows.groupBy("page_id", "section").agg(F.first("title", ignorenulls=True).alias("title"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.sum(F.when(F.col("tag") == "p", F.length("body")).otherwise(0)).alias("chars"))


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A small table as one Markdown text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("markdown"))
