"""Declarative checks that route rows to valid, quarantined or discarded, with reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Check:
    """``fails`` is true for a bad value; null doesn't fail. A discarding check outweighs others."""

    name: str
    fails: Column
    discards: bool = False


def budget_checks(now: Column) -> list[Check]:
    """The contract of budget records; ``now`` is passed in so that runs agree."""
    c = F.col
    return [
        Check("budget_id:not_null", c("budget_id").isNull()),
        Check("budget_id:str_matches", ~c("budget_id").rlike(r"^BUDGET-\d{4}-\d{4}$"), True),
        Check("client_name:not_null", c("client_name").isNull()),
        Check("client_name:str_length", ~F.length("client_name").between(2, 200)),
        Check("client_code:str_matches", ~c("client_code").rlike(r"^CLI-\d{4}$"), True),
        Check("total_amount:not_null", c("total_amount").isNull()),
        Check("total_amount:in_range", ~c("total_amount").between(0, 1e7), True),
        Check("currency:isin", ~F.coalesce(c("currency").isin("EUR", "USD", "GBP"), F.lit(False))),
        Check("hours_estimated:in_range", ~((c("hours_estimated") > 0) & (c("hours_estimated") <= 1e5)), True),
        Check("signed_at:not_null", c("signed_at").isNull()),
        Check("signed_at:signature_not_in_the_future", c("signed_at") > now, True),
        Check("status:isin", ~F.coalesce(c("status").isin("draft", "signed", "rejected"), F.lit(False))),
        Check("row:signed_needs_amount", (c("status") == "signed") & (c("total_amount") <= 0)),
    ]


def validate(df: DataFrame, checks: list[Check], mode: str = "strict") -> DataFrame:
    """``df`` with ``failures`` (names of all checks that fail) and ``outcome``. In permissive mode
    nothing is discarded. One projection: rows are neither joined nor counted."""
    # each check is told once; which of the names are fatal is asked of the names
    named = lambda some: F.array_compact(F.array(*[F.when(k.fails, k.name) for k in some])) if some else F.array().cast("array<string>")
    fatal_names = [k.name for k in checks if k.discards] if mode == "strict" else []
    fatal = F.arrays_overlap("failures", F.array(*[F.lit(n) for n in fatal_names])) if fatal_names else F.lit(False)
    out = df.withColumn("failures", named(checks)).withColumn("fatal", fatal)
    outcome = F.when(F.size("failures") == 0, "valid").when(F.col("fatal"), "discarded").otherwise("quarantined")
    return out.withColumn("outcome", outcome).drop("fatal")


def reasons(failures: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(failures)), "; ")


def breakdown(validated: DataFrame) -> DataFrame:
    """Failures by check."""
    return validated.select(F.explode("failures").alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def report(validated: DataFrame) -> DataFrame:
    """One row: total, valid, quarantined, discarded, pass_rate (0 without rows)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return validated.agg(F.count("*").alias("total"), n("valid").alias("valid"), n("quarantined").alias("quarantined"), n("discarded").alias("discarded"), F.round(F.coalesce(F.try_divide(n("valid"), F.count("*")), F.lit(0.0)), 6).alias("pass_rate"))


def projected(df: DataFrame, contract: str) -> DataFrame:
    """The contract's columns (a DDL schema) in its order; others are left out. A column that is missing or of
    another type is an error, and nothing is cast: that would hide a fault of the cleaning."""
    want = StructType.fromDDL(contract)
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'} instead of {f.dataType.simpleString()}" for f in want.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df.select(*want.names)
