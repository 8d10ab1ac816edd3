"""Texts that are made of rows: score bars, the audit of a catalog, request templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import QUALITIES, rag_ready, staleness, weakest


def score_bar(score: Column, most: int = 5) -> Column:
    return F.concat(F.repeat(F.lit("●"), score), F.repeat(F.lit("○"), F.lit(most) - score))


def quality_lines(catalog: DataFrame) -> DataFrame:
    """(name, line): a Markdown table line for each source, with bars, verdict and decision."""
    bars = F.concat_ws(" | ", *[score_bar(F.col(q)) for q in QUALITIES])
    verdict = F.when(rag_ready(), "yes").otherwise(F.concat(F.lit("**no** ("), weakest(), F.lit(")")))
    return catalog.select("name", F.concat(F.lit("| `"), "name", F.lit("` | "), bars, F.lit(" | "), verdict, F.lit(" | "), "decision", F.lit(" |")).alias("line"))


def freshness_lines(catalog: DataFrame) -> DataFrame:
    """(name, line): declared refresh, days since the last change, and how that is judged."""
    return catalog.select("name", F.concat(F.lit("| `"), "name", F.lit("` | "), "refresh", F.lit(" | "), F.col("lag_days").cast("string"), F.lit(" | "), staleness(F.col("lag_days"), F.col("refresh")), F.lit(" |")).alias("line"))


def audit(catalog: DataFrame, report: DataFrame | None = None, divergent: DataFrame | None = None) -> DataFrame:
    """One row ``markdown``: the audit of a catalog (a line a source), and of a run if there is one.

    Sections without a source are left out. Columns that the catalog lacks (notes, records, size_mb,
    owners, upstream, pii_types, access_restrictions) show as a dash. ``divergent`` (source, id) names
    records of the run that came in several versions.
    """
    given = lambda c, none="—": F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(none)) if c in catalog.columns else F.lit(none)
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def section(rows: DataFrame, title: str, head: str | None = None) -> DataFrame:
        top = f"## {title}\n\n" + (f"{head}\n|{'---|' * (head.count('|') - 1)}\n" if head else "")
        lines = F.array_sort(F.collect_list(F.struct("name", "line")))
        made = rows.agg(F.count("*").alias("n"), F.concat(F.lit(top), F.array_join(F.transform(lines, lambda r: r["line"]), "\n")).alias("part"))
        return made.where("n > 0").select("part")

    def listed(where: Column, *cells: Column) -> DataFrame:
        return catalog.where(where).select("name", F.concat(F.lit("- **"), tick(F.col("name")), F.lit("** "), *cells).alias("line"))

    counts = catalog.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("include", "exclude", "review")], F.count("*").alias("n"))
    head = counts.select(F.format_string("# Audit of sources\n\n%d sources: %d included, %d excluded, %d under review", "n", "include", "exclude", "review").alias("part"))
    included, weak = F.col("decision") == "include", F.element_at(F.create_map(*[x for q in QUALITIES for x in (F.lit(q), F.col(q))]), weakest())
    kinds = F.coalesce(F.nullif(F.array_join("pii_types", ", "), F.lit("")), F.lit("—")) if "pii_types" in catalog.columns else F.lit("—")
    private = catalog.select("name", row(tick(F.col("name")), F.when(F.col("contains_pii"), "yes").otherwise("no"), kinds, given("access_restrictions")).alias("line"))
    parts = [
        head,
        section(quality_lines(catalog), "Quality", "| source | completeness | consistency | actuality | reliability | ready | decision |"),
        section(freshness_lines(catalog), "Freshness", "| source | refresh | days | verdict |"),
        section(listed(included & ~rag_ready(), F.lit("weak in "), weakest(), F.concat(F.lit(" ("), weak.cast("string"), F.lit("/5): ")), given("notes", "no reason given")), "Included though not ready"),
        section(listed(included, F.concat(F.lit("("), F.col("format"), F.lit(", "), given("records"), F.lit(" records, "), given("size_mb"), F.lit(" MB), business: "), given("owner_business"), F.lit(", technical: "), given("owner_technical"), F.lit(", from: "), given("upstream"))), "Included"),
        section(listed(F.col("decision") == "review", given("notes")), "Under review"),
        section(listed(F.col("decision") == "exclude", given("notes")), "Excluded"),
        section(private, "Personal data", "| source | personal data | kinds | access |"),
    ]
    if report is not None:
        numbers = ["files_seen", "units_parsed", "units_kept", "documents", "records_valid", "records_quarantined", "records_discarded", "entities_replaced"]
        ran = report.select(F.col("source").alias("name"), row(tick(F.col("source")), F.col("decision"), *[F.col(c).cast("string") for c in numbers]).alias("line"))
        parts.append(section(ran, "Last run", "| source | decision | files | units | kept | documents | valid | quarantined | discarded | replaced |"))
        if divergent is not None:
            ids = divergent.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids"))
            parts.append(section(ids.select(F.col("source").alias("name"), F.concat(F.lit("- "), tick(F.col("source")), F.lit(": "), "ids", F.lit(" (the latest date stands)")).alias("line")), "Versions that differ"))
        parts.append(section(report.where("errors is not null").select(F.col("source").alias("name"), F.concat(F.lit("- "), tick(F.col("source")), F.lit(": "), "errors").alias("line")), "Errors"))
    joined = None
    for k, p in enumerate(parts):
        one = p.select(F.lit(k).alias("k"), "part")
        joined = one if joined is None else joined.union(one)
    return joined.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda r: r["part"]), "\n\n").alias("markdown"))


TONES = {"confidential": "Do not repeat names or figures.", "regulated": "Name the rules that apply.", "developer": "Use technical terms.", "small": "Keep the plan small."}
FORMATS = {"table": "Answer with a table.", "phases": "Answer by phases."}
DETAILS = {"brief": "Be brief.", "full": "Explain every figure."}


def prompt(request: Column, tier: Column, form: Column, detail: Column, technologies: Column, summary: Column) -> Column:
    """A request to a model, from parts; a part that is empty is left out, but the request must be there
    (a null one raises an error)."""
    pick = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    known = F.when(F.size(technologies) > 0, F.concat(F.lit("Technologies: "), F.array_join(technologies, ", "), F.lit(".")))
    before = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("So far: "), summary))
    given = F.coalesce(request, F.raise_error(F.lit("a prompt needs its request")).cast("string"))
    return F.concat_ws("\n", F.lit("Estimate the work."), pick(TONES, tier), pick(FORMATS, form), pick(DETAILS, detail), known, before, F.concat(F.lit("Request: "), given))


def prompt_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(12))


def numbered(rows: DataFrame, by: str, place: str, text: str) -> DataFrame:
    """One text of numbered blocks for each group, in order of ``place``."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(text).alias("text"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), p["text"])), "\n\n").alias("examples"))
