"""Requests: bounds of their fields, keys of equal ones, moderation, markers that an answer should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cache_key
from ..functions.text import cache_text
from .validation import Check

# Least and most characters of each field of a request.
BOUNDS = {"description": (20, 80_000), "transcript": (10, 80_000), "transcription": (50, None), "question": (3, 2000)}
MOST_RESULTS = 50


def request_checks(fields: list[str]) -> list[Check]:
    """Bounds of the named text fields (white space at the ends doesn't count), and of ``top_k`` if it is named."""
    out = []
    for name in fields:
        if name == "top_k":
            out.append(Check("top_k:in_range", ~F.coalesce(F.col("top_k").between(1, MOST_RESULTS), F.lit(False))))
            continue
        low, high = BOUNDS[name]
        size = F.length(F.trim(F.coalesce(F.col(name), F.lit(""))))
        out.append(Check(f"{name}:too_short", size < low))
        if high is not None:
            out.append(Check(f"{name}:too_long", size > high))
    return out


def request_key(prefix: str, text: Column, **choices: Column) -> Column:
    """The key of a request: its text without differences of case and white space, and its choices."""
    return cache_key(prefix, text=cache_text(text), **choices)


def flagged_categories(scores: Column, threshold: float) -> Column:
    """Names of the moderation categories of a map that reach the threshold, in order."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: v >= threshold)))


def marker_recall(answers: DataFrame, by: list[str], text: str, markers: dict[str, list[str]]) -> DataFrame:
    """(by, recall, detail): the share of markers of which an answer holds one of the needles, and
    each as ``position=1;...``. The markers are a short list that goes along with every row."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def hit(needles: list[str]) -> Column:
        out = F.lit(False)
        for n in needles:
            out = out | F.contains(low, F.lit(n.lower()))
        return out.cast("int")

    found = {k: hit(v) for k, v in markers.items()}
    mean = F.round(sum(found.values(), F.lit(0)) / float(len(found)), 4)
    return answers.select(*by, mean.alias("recall"), F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in found.items()]).alias("detail"))


def lag_days(audited: Column, changed: Column) -> Column:
    """Whole days between the last change and the audit."""
    return F.datediff(audited, changed)
