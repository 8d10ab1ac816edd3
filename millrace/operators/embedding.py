"""What is embedded: checks of budgets with nested components, their chunks, and what goes with each chunk."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import hours
from ..functions.text import estimated_tokens, strip
from .validation import Check

SEPARATOR = "::"
# Sectors with their other spellings, grades of complexity, keys that every chunk has, the longest chunk.
SECTORS = ["finance", "ecommerce", "healthcare", "industrial"]
SECTOR_ALIASES = {"fintech": "finance", "financial": "finance", "banking": "finance", "e-commerce": "ecommerce", "e_commerce": "ecommerce", "retail": "ecommerce", "health": "healthcare", "medical": "healthcare", "manufacturing": "industrial"}
COMPLEXITIES = ["low", "medium", "high"]
REQUIRED = ["budget_id", "component_id", "client_sector", "client_country", "main_technology", "year", "complexity", "estimated_hours", "tech_stack"]
MOST_TOKENS, MOST_BUDGETS = 8191, 500


def sector(value: Column) -> Column:
    """A sector's one spelling; what is unknown stays in lower case."""
    folded = F.lower(strip(value))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SECTOR_ALIASES.items() for x in pair]), folded), folded)


def _length(value: Column, most: int) -> Column:
    return ~F.coalesce(F.length(value).between(1, most), F.lit(False))


def _between(value: Column, low: float, high: float, open_: bool = False) -> Column:
    return ~F.coalesce((value > low if open_ else value >= low) & (value <= high), F.lit(False))


def budget_checks() -> list[Check]:
    """Bounds of a budget (budget_id, client struct, summary, technology, year, hours, components)."""
    c, client, parts = F.col, F.col("client"), F.col("components")
    some = lambda test: F.coalesce(F.exists(parts, test), F.lit(False))
    return [
        Check("budget_id", _length(c("budget_id"), 64) | F.coalesce(F.contains("budget_id", F.lit(SEPARATOR)), F.lit(False))),
        Check("client.name", _length(client["name"], 120)),
        Check("client.sector", ~F.coalesce(sector(client["sector"]).isin(SECTORS), F.lit(False))),
        Check("client.country", ~F.coalesce(client["country"].rlike("^[A-Z]{2}$"), F.lit(False))),
        Check("project_summary", _length(c("project_summary"), 4000)),
        Check("main_technology", _length(c("main_technology"), 80)),
        Check("year", _between(c("year"), 2000, 2100)),
        Check("total_estimated_hours", _between(c("total_estimated_hours"), 0, 1_000_000, True)),
        Check("components", F.coalesce(F.size(parts), F.lit(0)) < 1),
        Check("component.component_id", some(lambda p: _length(p["component_id"], 64) | F.coalesce(F.contains(p["component_id"], F.lit(SEPARATOR)), F.lit(False)))),
        Check("component.name", some(lambda p: _length(p["name"], 200))),
        Check("component.description", some(lambda p: _length(p["description"], 8000))),
        Check("component.estimated_hours", some(lambda p: _between(p["estimated_hours"], 0, 100_000, True))),
        Check("component.complexity", some(lambda p: ~F.coalesce(p["complexity"].isin(COMPLEXITIES), F.lit(False)))),
    ]


def chunks(budgets: DataFrame) -> DataFrame:
    """(chunk_id, place, text, metadata, tokens, oversized): one chunk for each component, in order,
    with its budget as context. A chunk that is too long is reported, never split."""
    rows = budgets.select("*", F.posexplode("components").alias("place", "part"))
    stack = F.array_join("part.tech_stack", ", ")
    text = F.concat_ws("\n", F.concat(F.lit("Project: "), "project_summary"), F.concat(F.lit("Client: "), F.col("client.name"), F.lit(" ("), sector(F.col("client.sector")), F.lit(", "), F.col("client.country"), F.lit(")")), F.concat(F.lit("Technology: "), "main_technology"), F.concat(F.lit("Component: "), F.col("part.name")), F.col("part.description"), F.when(stack != "", F.concat(F.lit("Stack: "), stack)), F.concat(F.lit("Hours: "), hours(F.col("part.estimated_hours"))), F.concat(F.lit("Complexity: "), F.col("part.complexity")))
    values = {"budget_id": F.col("budget_id"), "component_id": F.col("part.component_id"), "client_sector": sector(F.col("client.sector")), "client_country": F.col("client.country"), "main_technology": F.col("main_technology"), "year": F.col("year").cast("string"), "complexity": F.col("part.complexity"), "estimated_hours": hours(F.col("part.estimated_hours")), "tech_stack": stack}
    metadata = F.create_map(*[x for k in REQUIRED for x in (F.lit(k), values[k])])
    out = rows.select(F.concat(F.col("budget_id"), F.lit(SEPARATOR), F.col("part.component_id")).alias("chunk_id"), "place", text.alias("text"), metadata.alias("metadata")).withColumn("tokens", estimated_tokens(F.col("text")))
    return out.withColumn("oversized", F.col("tokens") > MOST_TOKENS)


def has_required(metadata: Column, required: list[str] = REQUIRED) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(k) for k in required]), F.map_keys(metadata))) == 0


def search(vectors: DataFrame, question: list[float], k: int, metadata: Column | None = None) -> DataFrame:
    """The k vectors (1 to 50) most similar to a question, ties by id; ``metadata`` may narrow them first."""
    from ..functions.vectors import cosine

    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50")
    rows = vectors if metadata is None else vectors.where(metadata)
    asked = F.array(*[F.lit(float(x)) for x in question])
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), asked), 6).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), "vec_id").limit(k)


def request_sizes(budgets: DataFrame, by: list[str], most: int = MOST_BUDGETS) -> DataFrame:
    """(by..., budgets, too_many): how many budgets each request holds, and whether that is over the limit."""
    return budgets.groupBy(*by).agg(F.count("*").alias("budgets"), (F.count("*") > most).alias("too_many"))


#: Texts in one request, and seconds to wait after each time that a vectoriser is told to slow down.
REQUEST_TEXTS, WAITS = 100, (1.0, 2.0, 4.0, 8.0)
#: What a vectoriser answers: the place of a text in the request, and its vector, in any order.
Vectorise = Callable[[list[str]], list[tuple[int, list[float]]]]


class SlowDown(Exception):
    """A vectoriser's limit of requests is reached; the only error that waiting mends."""


def ask(vectorise: Vectorise, texts: list[str], dimension: int, waits: tuple[float, ...] = WAITS) -> list[list[float]]:
    """The vectors of the texts in their order. A request is repeated after ``SlowDown`` as often as there
    are waits; other errors are the caller's, as is an answer that lacks a text or has another dimension."""
    for wait in (*waits, None):
        try:
            answer = dict(vectorise(texts))
            break
        except SlowDown:
            if wait is None:
                raise
            time.sleep(wait)
    if sorted(answer) != list(range(len(texts))):
        raise ValueError(f"{len(texts)} texts were sent, the answer has places {sorted(answer)[:5]}... ({len(answer)})")
    wrong = next((len(v) for v in answer.values() if len(v) != dimension), None)
    if wrong is not None:
        raise ValueError(f"vectors have {wrong} dimensions instead of {dimension}")
    return [answer[k] for k in range(len(texts))]


def embed(chunks: DataFrame, vectorise: Vectorise, dimension: int, text: str = "text", most: int = REQUEST_TEXTS, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """``chunks`` with ``embedding`` and ``request``, the number of the request in its task.

    Requests are cut across Arrow batches, so all of a task's are full but the last. Null texts are sent
    empty. A task that fails is run again as a whole by Spark.
    """
    schema = chunks.withColumns({"embedding": F.array(F.lit(0.0)), "request": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, number = None, 0

        def answered(rows: pa.Table, number: int) -> pa.RecordBatch:
            vectors = ask(vectorise, [t or "" for t in rows.column(text).to_pylist()], dimension, waits)
            out = rows.combine_chunks().append_column("embedding", pa.array(vectors, pa.list_(pa.float64()))).append_column("request", pa.array([number] * len(rows), pa.int32()))
            return out.to_batches()[0]

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            while len(waiting) >= most:
                yield answered(waiting.slice(0, most), number)
                waiting, number = waiting.slice(most), number + 1
        if waiting is not None and len(waiting):
            yield answered(waiting, number)

    return chunks.mapInArrow(run, schema)
