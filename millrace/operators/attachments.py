"""Attachments of a request: whether their text is of use, what becomes of each, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, word_count

# What a useful text has at least, and the most words that are taken.
LEAST_CHARACTERS, LEAST_PRINTABLE, MOST_WORDS = 30, 0.85, 8000


def printable_characters(text: Column) -> Column:
    """Characters that aren't control, format or separator ones; blanks, tabs and line ends count as printable."""
    return F.length(F.regexp_replace(F.translate(text, "\n\t ", "xxx"), r"[\p{C}\p{Z}]", ""))


def fault(text: Column, units: Column | None = None) -> Column:
    """Why an extracted text is of no use, the first rule first; null if it is."""
    bare = strip(F.coalesce(text, F.lit("")))
    pages = F.greatest(units, F.lit(1)) if units is not None else F.lit(1)
    few, odd = F.length(bare) < LEAST_CHARACTERS * pages, printable_characters(bare) < LEAST_PRINTABLE * F.length(bare)
    return F.when(bare == "", "no text").when(few, "few characters").when(odd, "not printable")


#: Letters of a word on average from which an extraction is suspected to have lost its spaces.
LONG_WORD = 40


def warning(text: Column) -> Column:
    """What is odd about a text that is taken all the same; null if nothing is."""
    words = word_count(text)
    return F.when(F.try_divide(F.length(strip(text)), words) > LONG_WORD, "long words")


def route(rows: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows (text, kind, ...) with ``words``, ``method``, ``note`` and ``ratio`` of the limit.

    A text of no use goes to the fallback if it is a pdf, else it failed; one over the limit is
    turned away whole, never cut. A null text has no words and is of no use.
    """
    words = F.coalesce(word_count(F.col("text")), F.lit(0))
    out = rows.withColumns({"words": words, "__fault": fault(F.col("text"))})
    long = F.col("words") > most_words
    method = F.when(F.col("__fault").isNotNull(), F.when(F.col("kind") == "pdf", "fallback").otherwise("failed")).when(long, "too_long").otherwise("extracted")
    said = F.concat(F.lit("about "), F.format_number("words", 0), F.lit(f" words, at most {most_words:,}"))
    return out.withColumns({"method": method, "note": F.coalesce("__fault", F.when(long, said)), "ratio": F.round(F.col("words") / float(most_words), 6)}).drop("__fault")


def block(rows: DataFrame, by: str, place: str) -> DataFrame:
    """One text for each request (``by``): its attachments (filename, text) in order of ``place``. Rows that ``route`` has
    judged (``method``, ``note``) are left out unless they were extracted; ``notes`` says of each why."""
    one = F.concat(F.lit("<attachment filename='"), "filename", F.lit("'>\n"), "text", F.lit("\n</attachment>"))
    judged = "method" in rows.columns
    fine = F.col("method") == "extracted" if judged else F.lit(True)
    listed = lambda which, text: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(F.col(place).alias("place"), text.alias("one"))))), lambda p: p["one"])
    out = [F.array_join(listed(fine, one), "\n\n").alias("block")]
    if judged:
        out.append(listed(~fine, F.concat("filename", F.lit(": "), F.coalesce("note", "method"))).alias("notes"))
    return rows.groupBy(by).agg(*out)


def data_url(content: Column, media_type: Column) -> Column:
    """The bytes of a file as a base64 data URL, without the line ends that base64 may have."""
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def last_of_name(rows: DataFrame, name: str, place: str) -> DataFrame:
    """Of files with one name the last."""
    return rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), place).alias("row")).select("row.*")
