"""Spans of regular expressions as columns: positions in code points, without Python on the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


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
        count = F.ceil(F.size(known) / STRIDE).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(known, k * STRIDE + 1, F.lit(STRIDE)))
        sums = lambda ps: F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return bound(parts, lambda ps: bound(before(sums(ps), F.lit(0)), lambda firsts: F.flatten(F.zip_with(ps, firsts, before))))

    return bound(lengths, of)


def find_all(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost, non-overlapping matches of a pattern that never matches nothing.

    The pieces between matches come from ``split``, the matches from ``regexp_extract_all``; both
    walk over the text in the same way, so their lengths give the positions. Texts without a
    match are told by one cached search.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(steps: Column) -> Column:
        # a match begins after all gaps and matches before it and its own gap
        starts = running(F.transform(steps, lambda s: s["gap"] + F.length(s["match"])))
        return F.zip_with(steps, starts, lambda s, at: F.struct(F.lit(kind).alias("kind"), (at + s["gap"]).alias("start"), (at + s["gap"] + F.length(s["match"])).alias("end"), s["match"].alias("match")))

    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    spans = bound(F.filter(steps, lambda s: s["match"].isNotNull()), placed)
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


#: Code points of a piece in which surroundings are looked up: finding a place in a whole text starts at its beginning.
PIECE = 256


def with_surroundings(text: Column, spans: Column, left: int) -> Column:
    """Spans with ``left``, up to so many code points (``PIECE`` at most) before them, and ``right``, the one after."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(known: Column, at: Column, size: Column) -> Column:
        k = F.floor(at / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get(known, k), F.lit("")), F.coalesce(F.get(known, k + 1), F.lit("")))
        return two.substr((at % PIECE + 1).cast("int"), size)

    def widened(known: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), cut(known, F.greatest(s["start"] - left, F.lit(0)), F.least(s["start"], F.lit(left))).alias("left"), cut(known, s["end"], F.lit(1)).alias("right")))

    return bound(F.when(F.size(spans) > 0, pieces).otherwise(F.array().cast("array<string>")), widened)


def place_of(kind: Column, kinds: Sequence[str]) -> Column:
    """A kind's place in the list."""
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind).cast("int")


def joined(spans: Column, kinds: Sequence[str], by_kind: bool) -> Column:
    """``kind:start:end`` by start, then kind, or (``by_kind``) by kind, then start; comma-joined."""
    keys = F.transform(spans, lambda s: F.struct(*([place_of(s["kind"], kinds).alias("a"), s["start"].alias("b")] if by_kind else [s["start"].alias("a"), place_of(s["kind"], kinds).alias("b")]), s["end"].alias("c"), s["kind"].alias("kind"), s["start"].alias("start")))
    return F.concat_ws(",", F.transform(F.array_sort(keys), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["c"].cast("string"))))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
