"""An ingest run: the sources of a catalog to canonical documents, with a report for each source.

Units of all sources are made once and written with their source and outcome; documents and report
are read from there. Every source goes through the same stages: list its files, parse them by its format, clean, (records)
validate and route, pseudonymise where it holds personal data, and name the documents. A source that
is left out, or whose format nothing reads, shows in the report only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.firsts import first_values
from ..functions.records import hours, money
from ..functions.text import document_id, drop_reason, is_placeholder, normalise_text
from ..sources.files import json_records, local_path, read_files, texts
from ..sources.pdf import pdf_texts
from ..sources.storage import Scope
from ..sources.office import document_blocks, document_sections, workbook_rows, workbook_sheets
from . import privacy, validation
from .documents import pages, transcript_units
from .records import clean_records, keep_latest

DOCUMENTS = "id string, source string, document string, unit_key string, title string, speaker string, content string, anonymised boolean, placeholder boolean, catalog_version string"
REPORT = "source string, decision string, files_seen long, units_parsed long, records_valid long, records_quarantined long, records_discarded long, units_kept long, entities_replaced long, documents long, duplicate_ids long, errors string, skipped_reason string"
RECORD = "budget_id string, client_name string, client_code string, total_amount string, currency string, hours_estimated string, signed_at string, status string, phases array<struct<name:string,hours:double,cost:double>>"


def render_record(row: dict[str, Column]) -> Column:
    """A budget record as Markdown: a heading, its fields, and its phases as a table if it has any."""
    field = lambda label, value: F.concat(F.lit(f"- {label}: "), value)
    cells = F.transform(row["phases"], lambda p: F.concat(F.lit("| "), F.coalesce(p["name"], F.lit("")), F.lit(" | "), F.coalesce(hours(p["hours"]), F.lit("")), F.lit(" | "), F.coalesce(money(p["cost"]), F.lit("")), F.lit(" |")))
    table = F.when(F.size(row["phases"]) > 0, F.concat(F.lit("\n| Phase | Hours | Cost |\n|---|---|---|\n"), F.array_join(cells, "\n")))
    return F.concat_ws("\n", F.concat(F.lit("# Budget "), row["budget_id"]), field("Client", row["client_name"]), field("Code", row["client_code"]), field("Amount", F.concat(money(row["total_amount"]), F.lit(" "), row["currency"])), field("Hours", hours(row["hours_estimated"])), field("Signed", F.date_format(row["signed_at"], "yyyy-MM-dd")), field("Status", row["status"]), table)


def _plain(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """Units (document, unit_key, title, speaker, content); what a format lacks is null."""
    none = F.lit(None).cast("string")
    return rows.select(*[columns.get(c, none).alias(c) for c in ("document", "unit_key", "title", "speaker", "content")])


def _text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    units = transcript_units(texts(files).select("path", "text"))
    return _plain(units, document=F.col("path"), unit_key=F.col("unit_key"), speaker=F.col("speaker"), content=F.col("content")), _no_errors(files)


def _paged(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages: of text layers with page marks, and of packed PDFs, by the first way that gives a text of use."""
    packed = F.startswith(F.hex(F.substring("content", 1, 4)), F.lit("25504446"))
    units = pages(texts(files.where(~packed)).select("path", "text"))
    found = pdf_texts(files.where(packed))
    layers = found.where("error is null").select("path", F.posexplode("pages").alias("n", "content"))
    layers = layers.select("path", F.format_string("page-%04d", F.col("n") + 1).alias("unit_key"), "content")
    both = units.select("path", "unit_key", "content").unionByName(layers)
    return _plain(both, document=F.col("path"), unit_key=F.col("unit_key"), content=F.col("content")), found.where("error is not null").select("path", "error")


def _docx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    blocks = document_blocks(files)
    units = document_sections(blocks)
    return _plain(units, document=F.col("path"), unit_key=F.col("unit_key"), title=F.col("title"), content=F.col("content")), blocks.where("error is not null").select("path", "error")


def _xlsx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = workbook_rows(files)
    units = workbook_sheets(rows)
    return _plain(units, document=F.col("path"), unit_key=F.col("unit_key"), title=F.col("title"), content=F.col("content")), rows.where("error is not null").select("path", "error")


def _no_errors(files: DataFrame) -> DataFrame:
    return files.limit(0).select("path", F.lit("").alias("error"))


#: Readers by format: from files to units and errors (path, error). More may be registered.
READERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {"txt": _text, "pdf": _paged, "docx": _docx, "xlsx": _xlsx}


def anonymised(units: DataFrame, key: str) -> DataFrame:
    """Units with names of persons and companies replaced in content and speaker, and ``replaced``, their number."""
    body, who = F.coalesce("content", F.lit("")), F.coalesce("speaker", F.lit(""))
    rows = units.withColumns({"__body": privacy.detect(body), "__who": privacy.detect(who)})
    return rows.withColumns({"content": privacy.replace_spans(body, F.col("__body"), key), "speaker": F.when(F.col("speaker").isNotNull(), privacy.replace_spans(who, F.col("__who"), key)), "replaced": F.size("__body") + F.size("__who")}).drop("__body", "__who")


def units(files: DataFrame, sources: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(units, errors) of a table or a stream of files with their ``source``, by the formats of the sources."""
    found, broken = None, None
    for source in sources:
        mine, errors = READERS[source["format"]](files.where(F.col("source") == source["name"]))
        mine, errors = (df.withColumn("source", F.lit(source["name"])) for df in (mine, errors))
        found = mine if found is None else found.unionByName(mine)
        broken = errors if broken is None else broken.unionByName(errors)
    return found, broken


STAGED = "source string, path string, unit_key string, title string, speaker string, content string, placeholder boolean, outcome string, parsed long, replaced long, files long, error string"


def _staged(rows: DataFrame, source: str) -> DataFrame:
    """Rows of one source with all columns of ``STAGED``; those that ``rows`` lacks are null."""
    return rows.select(*[(F.lit(source) if n == "source" else F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in STAGED.split(", "))])


def stage_source(spark: SparkSession, source: dict, root: str, now: Column, key: str) -> DataFrame:
    """Everything a source has: its units with their outcome (kept, dropped, or that of the checks), a row for each
    file that can't be read, and one with the number of files."""
    name, kind = source["name"], source["format"]
    folder = spark.range(1).select(local_path(F.lit(source["location"]), root)).first()[0]
    files = read_files(spark, folder, source.get("pattern") or "*")
    if kind == "json":
        records = json_records(files, RECORD)
        errors = records.where("broken").select(F.col("source_file").alias("path"), F.lit("not JSON").alias("error"))
        fields = [f.split(" ")[0] for f in RECORD.split(", ") if not f.startswith("phases")]
        good = records.where("not broken").withColumn("record", F.concat_ws("|", *fields))
        checked = validation.validate(keep_latest(clean_records(good), versions="parsed"), validation.budget_checks(now))
        content = F.when(F.col("outcome") == "valid", render_record({c: F.col(c) for c in checked.columns}))
        found = checked.select(F.col("source_file").alias("path"), F.col("budget_id").alias("unit_key"), content.alias("content"), F.lit(False).alias("placeholder"), "outcome", "parsed")
    else:
        parsed, errors = READERS[kind](files)
        tidied = parsed.withColumns({"placeholder": is_placeholder(F.col("content")), "content": normalise_text(F.col("content"))})
        outcome = F.when(drop_reason(F.col("content")).isNull(), "kept").otherwise("dropped")
        found = tidied.withColumnRenamed("document", "path").withColumns({"outcome": outcome, "parsed": F.lit(1)})
    if source.get("contains_pii"):
        # units are made once and written: a condition on the outcome of units not yet made would tidy each text for every
        # rule that looks at it, and either part would read and parse all files
        made = Scope(spark, "ingest").folder("made")
        found.write.parquet(made)
        found = spark.read.schema(found.schema).parquet(made)
        found = anonymised(found.where("outcome in ('valid', 'kept')"), key).unionByName(found.where("outcome not in ('valid', 'kept')").withColumn("replaced", F.lit(0)))
    return _staged(found, name).unionByName(_staged(errors, name)).unionByName(_staged(files.agg(F.count("*").alias("files")), name))


def run(catalog: DataFrame, root: str, now: Column, key: str, version: str = "1", names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of all sources of a catalog (or of those named).

    The catalog's rows pass through the driver: they are the plan of the run, one entry a source.
    What was staged lies in the shared folder, from where both results are read.
    """
    from ..sources.catalog import narrowed

    spark, scope = catalog.sparkSession, Scope(catalog.sparkSession, "ingest")
    plan = [s.asDict() for s in narrowed(catalog, names).collect()]
    readable = [s for s in plan if s["decision"] == "include" and (s["format"] == "json" or s["format"] in READERS)]
    for source in readable:
        stage_source(spark, source, root, now, key).write.mode("append").parquet(scope.folder("units"))
    staged = spark.read.schema(STAGED).parquet(scope.folder("units")) if readable else spark.createDataFrame([], STAGED)

    def skipped(s: dict) -> str | None:
        return None if s["decision"] == "include" else s.get("decision_reason") or f"catalog decision is '{s['decision']}'"

    def unread(s: dict) -> str | None:
        return None if s in readable or s["decision"] != "include" else f"no parser for format '{s['format']}'"

    rows = [(s["name"], s["decision"], bool(s.get("contains_pii")), re.sub(r"^[^:/]*://", "", s["location"]).strip("/"), skipped(s), unread(s)) for s in plan]
    known = spark.createDataFrame(rows, "source string, decision string, hidden boolean, folder string, skipped_reason string, unread string")
    # what the catalog says stands, whatever a file says of itself
    kept = staged.where("outcome in ('valid', 'kept')").join(F.broadcast(known.select("source", "hidden", "folder")), "source")
    at = F.position(F.concat(F.lit("/"), "folder", F.lit("/")), F.col("path")) + F.length("folder") + 2
    place = F.substring(F.col("path"), at, F.length("path"))
    placed = kept.withColumn("document", place).withColumn("id", document_id(F.col("source"), F.col("document"), F.coalesce("unit_key", F.lit(""))))
    documents = placed.select("id", "source", "document", "unit_key", "title", "speaker", "content", F.col("hidden").alias("anonymised"), "placeholder", F.lit(version).alias("catalog_version"))

    tally = lambda o: F.count_if(F.col("outcome") == o)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = staged.groupBy("source").agg(total("files").alias("files_seen"), total("parsed").alias("units_parsed"), *[tally(o).alias(f"records_{o}") for o in ("valid", "quarantined", "discarded")], (tally("valid") + tally("kept")).alias("units_kept"), total("replaced").alias("entities_replaced"))
    doubles = placed.groupBy("source", "id").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum(F.col("n") - 1).alias("duplicate_ids"))
    # of the errors the first three by path
    errors = first_values(staged.where("error is not null"), ["source"], F.concat(F.substring_index("path", "/", -1), F.lit(": "), "error"), 3)
    both = known.join(counts, "source", "left").join(doubles, "source", "left").join(errors, "source", "left")
    both = both.fillna(0).withColumn("documents", F.col("units_kept"))
    no_text = F.array().cast("array<string>")
    told = F.concat(F.coalesce("firsts", no_text), F.when(F.col("duplicate_ids") > 0, F.array(F.concat(F.col("duplicate_ids").cast("string"), F.lit(" duplicate document id(s)")))).otherwise(no_text))
    both = both.withColumn("errors", F.coalesce("unread", F.nullif(F.array_join(told, "; "), F.lit(""))))
    return documents, both.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in REPORT.split(", "))])


def totals(report: DataFrame) -> DataFrame:
    """One row for the run: sources, those with errors, documents, entities replaced."""
    return report.agg(F.count("*").alias("sources"), F.count_if(F.col("errors").isNotNull()).alias("failed"), F.count_if(F.col("skipped_reason").isNotNull()).alias("skipped"), F.sum("documents").alias("documents"), F.sum("entities_replaced").alias("entities_replaced"))
