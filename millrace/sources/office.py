"""Office documents (zipped XML) as rows: paragraphs and tables of a document, cells of a workbook.

Each task unpacks its own files with the standard library; everything after the rows is Spark.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Names of the formats' XML elements, and the styles that make a heading.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADING = re.compile(r"^(heading|título|titulo)", re.IGNORECASE)

_BLOCKS = "path string, pos int, kind string, text string, error string"
_CELLS = "path string, sheet int, title string, hidden boolean, row int, cells array<string>, error string"


def _document(content: bytes) -> Iterator[tuple[str, str]]:
    """(kind, text) of a document's blocks in order: heading, paragraph, row (cells joined)."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            yield ("heading" if style is not None and HEADING.match(style.get(f"{_W}val", "")) else "paragraph"), said(block)
        elif block.tag == f"{_W}tbl":
            for k, row in enumerate(block.iter(f"{_W}tr")):
                yield ("head" if k == 0 else "row"), " | ".join(said(c).strip() for c in row.iter(f"{_W}tc"))


def _workbook(content: bytes) -> Iterator[tuple[int, str, bool, int, list[str]]]:
    """(sheet, title, hidden, row, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        names = set(packed.namelist())
        strings = ["".join(t.text or "" for t in e.iter(f"{_S}t")) for e in ElementTree.fromstring(packed.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(packed.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ElementTree.fromstring(packed.read("xl/workbook.xml")).iter(f"{_S}sheet")):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            data = ElementTree.fromstring(packed.read(target if target.startswith("xl/") else f"xl/{target}"))
            for n, row in enumerate(data.iter(f"{_S}row")):
                cells: list[str] = []
                for cell in row.iter(f"{_S}c"):
                    column = 0
                    for letter in re.match("[A-Z]*", cell.get("r", "")).group():
                        column = column * 26 + ord(letter) - 64
                    while len(cells) < column - 1:
                        cells.append("")
                    value = cell.find(f"{_S}v")
                    plain = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    cells.append((strings[int(plain)] if cell.get("t") == "s" and plain else plain).strip())
                yield k, sheet.get("name", ""), sheet.get("state", "visible") != "visible", n, cells


def _each(files: DataFrame, unpack, schema: str) -> DataFrame:
    """Rows of every file; a file that can't be read gives one row with its error."""
    width = len(schema.split(", ")) - 2

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r, None) for r in unpack(content)]
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                    rows = [(path, *[None] * width, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(k).type) for k, c in enumerate(zip(*rows, strict=True))], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def document_blocks(files: DataFrame) -> DataFrame:
    """(path, pos, kind, text, error): the blocks of documents in order."""
    return _each(files, lambda content: ((k, *b) for k, b in enumerate(_document(content))), _BLOCKS)


def document_sections(blocks: DataFrame) -> DataFrame:
    """(path, unit_key, title, content): a unit for each heading with what follows it; what precedes
    the first heading has no title. Tables are Markdown. Sections without content are left out."""
    order = Window.partitionBy("path").orderBy("pos")
    rows = blocks.where(F.col("error").isNull()).withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(order))
    line = F.when(F.col("kind").isin("head", "row"), F.concat(F.lit("| "), "text", F.lit(" |"))).otherwise(F.trim("text"))
    rule = F.when(F.col("kind") == "head", F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.size(F.split("text", r" \| "))))).otherwise("")
    rows = rows.withColumn("line", F.when((F.col("kind") != "heading") & (F.trim("text") != ""), F.concat(line, rule)))
    parts = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line"))))
    out = rows.groupBy("path", "section").agg(F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("title"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("content"))
    return out.where("content <> ''").select("path", F.format_string("section-%04d", "section").alias("unit_key"), "title", "content")


def document_text(blocks: DataFrame) -> DataFrame:
    """(path, content): each document as one text, its paragraphs and rows in order, a line each."""
    rows = blocks.where(F.col("error").isNull() & (F.trim("text") != ""))
    lines = F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("line"))))
    return rows.groupBy("path").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, title, hidden, row, cells, error): the rows of workbooks."""
    return _each(files, _workbook, _CELLS)


def workbook_sheets(rows: DataFrame) -> DataFrame:
    """(path, unit_key, title, content): a Markdown table for each visible sheet that has two rows with
    something in them; the first is the heading."""
    some = rows.where(F.col("error").isNull() & ~F.col("hidden") & F.exists("cells", lambda c: c != ""))
    parts = F.array_sort(F.collect_list(F.struct("row", "cells")))
    sheets = some.groupBy("path", "sheet", "title").agg(parts.alias("rows")).where(F.size("rows") >= 2)
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    sheets = sheets.withColumn("width", width)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("width") - F.size(r["cells"]))), " | "), F.lit(" |"))
    lines = F.transform("rows", line)
    text = F.concat_ws("\n", F.element_at(lines, 1), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("width"))), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))
    return sheets.select("path", F.concat(F.lit("sheet-"), "title").alias("unit_key"), "title", text.alias("content"))
