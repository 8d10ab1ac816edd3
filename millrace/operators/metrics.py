"""Metrics over observations: each gives a score, whether it passed, and why; one that fails doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RESULT = "struct<score:double,passed:boolean,details:string>"
Judgement = tuple[float, bool, str]


@dataclass(frozen=True)
class Metric:
    """A name and what judges an observation: a column of type ``RESULT``, or a function of the observation
    as a dict, for what columns can't say; only a function may raise."""

    name: str
    judge: Column | Callable[[dict], Judgement]


def within(value: Column, limit: float, unit: str) -> Column:
    """Whether a value that may be text is within a limit, with the distance or what is wrong with the value."""
    text = value.cast("string")
    number = F.when(~F.isnan(text.try_cast("double")), text.try_cast("double"))
    fine = number <= limit
    shown = lambda c: F.regexp_replace(F.format_number(c, 2), ",", "")
    told = F.when(fine, F.concat(shown(number), F.lit(f" {unit}, "), shown(F.lit(limit) - number), F.lit(f" {unit} left"))).otherwise(F.concat(shown(number), F.lit(f" {unit}, "), shown(number - F.lit(limit)), F.lit(f" {unit} over")))
    wrong = F.when(text.isNull(), "no value").otherwise(F.concat(F.lit("not a number: "), text))
    good = F.struct(fine.cast("double"), fine, told).cast(RESULT)
    return F.when(number.isNull(), F.struct(F.lit(0.0), F.lit(False), wrong).cast(RESULT)).otherwise(good)


def judged(judge: Callable[[dict], Judgement], observation: dict) -> Judgement:
    """What a function says; if it raises, a failed result that tells the reason."""
    try:
        score, passed, details = judge(observation)
        return float(score), bool(passed), str(details)
    except Exception as e:  # noqa: BLE001 - whatever a metric raises is its own result
        return 0.0, False, f"metric raised {type(e).__name__}: {e}"


def run_metrics(rows: DataFrame, by: list[str], metrics: list[Metric]) -> DataFrame:
    """(by..., place, name, score, passed, details), a row for each observation and metric in the order given.

    Functions are run over Arrow batches, all of them in one pass; without any there is no Python.
    """
    plain = {k: m.judge for k, m in enumerate(metrics) if isinstance(m.judge, Column)}
    functions = {k: m.judge for k, m in enumerate(metrics) if k not in plain}
    out = rows.withColumns({f"__m{k}": c for k, c in plain.items()})
    if functions:
        schema = StructType([*out.schema.fields, *StructType.fromDDL(f"__f array<{RESULT}>").fields])
        arrow = to_arrow_schema(schema)
        observed = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = []
                for observation in batch.select(observed).to_pylist():
                    results = [judged(f, observation) for f in functions.values()]
                    told.append([{"score": s, "passed": p, "details": d} for s, p, d in results])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, arrow.field("__f").type)], names=arrow.names)

        out = out.mapInArrow(run, schema)
    place = {k: n for n, k in enumerate(functions)}
    each = [F.struct(F.lit(k).alias("place"), F.lit(m.name).alias("name"), (F.col(f"__m{k}") if k in plain else F.get("__f", F.lit(place[k]))).alias("r")) for k, m in enumerate(metrics)]
    return out.select(*by, F.explode(F.array(*each)).alias("m")).select(*by, "m.place", "m.name", "m.r.score", "m.r.passed", "m.r.details")
