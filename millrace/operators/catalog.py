"""Sources: measured against declared facts, quality gates, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITIES = ("completeness", "consistency", "actuality", "reliability")
# Days of a refresh cycle.
CADENCE = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 91, "yearly": 365}


def rag_ready() -> Column:
    """Every quality is 3 or more."""
    return F.least(*QUALITIES) >= 3


def weakest() -> Column:
    """The quality with the least score, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.col(q).alias("score"), F.lit(k).alias("place"), F.lit(q).alias("name")) for k, q in enumerate(QUALITIES)]))["name"]


def staleness(lag_days: Column, cadence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CADENCE.items() for x in pair])
    missed = lag_days / F.coalesce(F.try_element_at(known, cadence), F.lit(365))
    return F.when(missed <= 1.25, "ok").when(missed <= 2.5, "late").otherwise("abandoned")


def drift(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """(source, field, declared, measured) where they differ: counts exactly, sizes by more than 10%
    and 0.005 MB, formats if any were measured and the declared isn't among them."""
    both = declared.join(measured, "source", "left")
    size = (F.col("declared_mb") != 0) & (F.abs(F.col("declared_mb") - F.coalesce("size_mb", F.lit(0.0))) > F.greatest(F.lit(0.005), F.col("declared_mb") * 0.1))
    row = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.cast("string").alias("declared"), b.cast("string").alias("measured"))
    count = F.coalesce("n", F.lit(0).cast("long"))
    formats = (F.size("formats") > 0) & ~F.array_contains("formats", F.col("format"))
    found = F.array_compact(F.array(F.when(F.col("records") != count, row("records", F.col("records"), count)), F.when(size, row("size_mb", F.round("declared_mb", 3), F.round(F.coalesce("size_mb", F.lit(0.0)), 3))), F.when(formats, row("format", F.col("format"), F.array_join(F.array_sort("formats"), ",")))))
    return both.select("source", F.explode(found).alias("d")).select("source", "d.field", "d.declared", "d.measured")


def violations(sources: DataFrame) -> DataFrame:
    """Catalog rows that break a rule, with the rules' names."""
    score = F.lit(False)
    for q in QUALITIES:
        score = score | ~F.coalesce(F.col(q).between(1, 5), F.lit(False))
    rules = [F.when(~F.col("name").rlike("^[a-z][a-z0-9_]*$"), "name"), F.when(~F.col("format").isin("json", "txt", "docx", "pdf", "xlsx", "csv"), "format"), F.when(score, "quality"), F.when((F.col("decision") != "include") & F.coalesce(F.trim("decision_reason") == "", F.lit(True)), "decision_reason")]
    return sources.withColumn("broken", F.array_compact(F.array(*rules))).where(F.size("broken") > 0).select("name", "broken")
