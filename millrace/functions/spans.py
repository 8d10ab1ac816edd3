"""Matches of regular expressions with their places in code points, by column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed up at once; an array that grows is copied at each step.
STRIDE = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """For an array of ints the sums of all elements before each one, in blocks of ``STRIDE``: the sums
    inside a block, and those of whole blocks before it."""

    def before(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def of(known: Column) -> Column:
        parts = blocks(known)
        sums = lambda ps: F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return bound(parts, lambda ps: bound(before(sums(ps), F.lit(0)), lambda firsts: F.flatten(F.zip_with(ps, firsts, before))))

    return bound(lengths, of)


#: ``at``: the bytes before a match, by which a text can be cut without counting code points again.
MATCH = "struct<start:int,stop:int,at:int,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, at, value>> of all leftmost, non-overlapping matches of a pattern that never matches nothing."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(steps: Column) -> Column:
        starts = running(F.transform(steps, lambda s: s["gap"] + F.length(s["value"])))
        bytes_ = running(F.transform(steps, lambda s: s["bytes"] + F.octet_length(s["value"])))
        places = F.zip_with(starts, bytes_, lambda a, b: F.struct(a.alias("start"), b.alias("at")))
        return F.zip_with(steps, places, lambda s, p: F.struct((p["start"] + s["gap"]).alias("start"), (p["start"] + s["gap"] + F.length(s["value"])).alias("stop"), (p["at"] + s["bytes"]).alias("at"), s["value"].alias("value")))

    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("bytes"), m.alias("value")))
    some = bound(F.filter(steps, lambda s: s["value"].isNotNull()), placed).cast(f"array<{MATCH}>")
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(f"array<{MATCH}>"))


def blocks(array: Column, size: int = STRIDE) -> Column:
    """An array as an array of arrays of ``size`` elements, the last of fewer."""
    count = F.ceil(F.size(array) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(array, k * size + 1, F.lit(size)))


def without_overlaps(ordered: Column, kind: str) -> Column:
    """Of spans in order those that begin at or after the end of the last one kept. ``kind`` is the spans' type.

    The fold works off blocks of ``STRIDE`` spans, each with an array of its own, as an array that grows
    by all spans would be copied for each of them.
    """
    start = F.struct(F.lit(0).alias("until"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.struct(s["stop"].alias("until"), F.concat(state["out"], F.array(s)).alias("out"))
        return F.when(s["start"] >= state["until"], kept).otherwise(state)

    def block(state: Column, spans: Column) -> Column:
        first = F.struct(state["until"].alias("until"), start["out"].alias("out"))
        return bound(F.aggregate(spans, first, step), lambda done: F.struct(done["until"].alias("until"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    none = F.struct(F.lit(0).alias("until"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(bound(ordered, lambda spans: blocks(spans)), none, block, lambda s: F.flatten(s["out"]))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a number's Luhn sum is a multiple of ten."""
    values = F.transform(F.filter(F.split(F.reverse(digits(number)), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).when(F.ascii(c) > 52, 2 * (F.ascii(c) - 48) - 9).otherwise(2 * (F.ascii(c) - 48)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (two letters, two digits, letters and digits) has the remainder 1."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1
