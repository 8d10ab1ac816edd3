"""Cleaning of budget records and the choice among versions of one record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..functions.records import parse_amount, parse_date
from ..functions.text import client_key, normalise_currency, unmask_null


def clean_records(raw: DataFrame) -> DataFrame:
    """Raw text columns as typed ones; columns that the rules don't name stay as they are."""
    masked = [c for c in ("client_name", "account_manager", "contact_email", "contact_phone", "project_type", "status", "client_code") if c in raw.columns]
    out = raw.withColumns({c: unmask_null(F.col(c)) for c in masked})
    typed = {"currency": normalise_currency(F.col("currency")), "total_amount": parse_amount(F.col("total_amount")), "signed_at": parse_date(F.col("signed_at")), "status": F.lower("status"), "client_code": F.upper("client_code"), "hours_estimated": F.col("hours_estimated").try_cast("double"), "client_key": client_key(F.col("client_name"))}
    return out.withColumns({k: v for k, v in typed.items() if k in out.columns or k == "client_key"})


def keep_latest(df: DataFrame, key: str = "budget_id", at: str = "signed_at", tie: str = "record", versions: str | None = None) -> DataFrame:
    """The version with the latest date of each key (no date is earliest; ties: the largest ``tie``), and
    how many there were if ``versions`` names a column for it.

    max_by combines before the shuffle, so a key with many versions isn't gathered in one task.
    """
    row = F.struct(*df.columns)
    order = F.struct(F.col(at).isNotNull(), F.col(at), F.col(tie))
    count = [F.count("*").alias(versions)] if versions else []
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, order).alias("row"), *count).select("row.*", *[c for c in (versions,) if c])


def divergence(df: DataFrame, key: str = "budget_id") -> DataFrame:
    """(key, versions, distinct_versions, exact_duplicates) of keys with several rows."""
    mark = fingerprint(F.col(key), F.col("total_amount"), F.col("currency"), F.col("status"))
    grouped = df.groupBy(key).agg(F.count("*").alias("versions"), F.countDistinct(mark).alias("distinct_versions"))
    return grouped.where("versions > 1").withColumn("exact_duplicates", F.col("versions") - F.col("distinct_versions"))
