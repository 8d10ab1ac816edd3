"""Messy tabular values: amounts, dates, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grouped amounts.
EUROPEAN = r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"
ENGLISH = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
# Accepted dates, as the shape of the text and its format. No text has two shapes.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\p{L}{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"),
]


def parse_amount(text: Column) -> Column:
    """An amount in European, English or plain spelling as double; null if it is none."""
    bare = F.regexp_replace(text.cast("string"), r"(?U)[\s€$]", "")
    plain = F.when(bare.rlike(EUROPEAN), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = plain.when(bare.rlike(ENGLISH), F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def parse_date(text: Column) -> Column:
    """A date in one of the accepted formats as a UTC timestamp; else null. The shape of the text
    decides on the format, so a text is parsed once and hardly ever in vain."""
    bare = F.trim(text)
    out = F.lit(None).cast("timestamp")
    for shape, form in reversed(DATE_FORMATS):
        out = F.when(bare.rlike(shape), F.try_to_timestamp(bare, F.lit(form))).otherwise(out)
    return out


def money(value: Column) -> Column:
    """1,234.50; what is no number stays as it is."""
    return F.coalesce(F.format_number(value.cast("string").try_cast("double"), 2), value.cast("string"))


def hours(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
