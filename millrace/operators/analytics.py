"""Evaluation analytics: nearest-rank percentiles, curves, pivots, thresholds, fits, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Half-open token buckets, and the ladder of latency limits.
TOKEN_BUCKETS = [0, 3500, 4500, 5500, 6500, 9000]
LIMITS = [4000, 6000, 8000, 10000, 15000]


#: One over the error of the sketch that says between which values a percentile lies.
ACCURACY = 10_000


def percentiles(rows: DataFrame, by: list[str], value: str, percents: tuple[int, ...], accuracy: int = ACCURACY) -> DataFrame:
    """(by, p50, ...): nearest-rank percentiles of numbers, the value at place ceil(p n / 100) in order.

    A mergeable sketch gives two values between which a percentile lies; equal values are counted before the
    shuffle, what is below the two is summed, and only what is between them is sorted. The result is exact: should
    a place not be between its two values, all of its group is sorted. Groups without a value are left out.
    """
    group = [f"__{c}" for c in by]
    known = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, group, strict=True)], F.col(value).alias("__value"))
    shares = [x for p in percents for x in (max(0.0, p / 100 - 2 / accuracy), min(1.0, p / 100 + 2 / accuracy))]
    edges = known.groupBy(*group).agg(F.percentile_approx("__value", shares, accuracy).alias("__edges"))
    counts = _same_group(known.groupBy(*group, "__value").agg(F.count("*").alias("__n")), edges, group)
    low, high = (lambda k: F.get("__edges", F.lit(2 * k))), (lambda k: F.get("__edges", F.lit(2 * k + 1)))
    within = lambda k: F.col("__value").between(low(k), high(k))
    total = lambda c: F.sum(F.when(c, F.col("__n")).otherwise(0))
    sums = counts.groupBy(*group).agg(F.sum("__n").alias("__all"), *[x for k in range(len(percents)) for x in (total(F.col("__value") < low(k)).alias(f"__below{k}"), total(within(k)).alias(f"__in{k}"))])
    targets = []
    for k, p in enumerate(percents):
        place = F.ceil(F.col("__all") * p / 100)
        holds = (F.col(f"__below{k}") < place) & (place <= F.col(f"__below{k}") + F.col(f"__in{k}"))
        targets.append(F.struct(holds.alias("holds"), F.when(holds, place - F.col(f"__below{k}")).otherwise(place).alias("place")).alias(f"__t{k}"))
    asked = _same_group(counts, sums.select(*group, *targets), group)
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__t{k}.place").alias("place"), (within(k) | ~F.col(f"__t{k}.holds")).alias("asked")) for k in range(len(percents))]), lambda x: x["asked"])
    asked = asked.select(*group, "__value", "__n", F.explode(each).alias("__p"))
    inside = Window.partitionBy(*group, "__p.k").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.withColumn("__at", F.sum("__n").over(inside)).where("__at >= __p.place")
    return found.groupBy(*group).agg(*[F.min(F.when(F.col("__p.k") == k, F.col("__value"))).alias(f"p{p}") for k, p in enumerate(percents)]).withColumnsRenamed(dict(zip(group, by, strict=True)))


def _same_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with what ``groups`` (a row each) says of their group; null is a group."""
    named = groups.withColumnsRenamed({c: f"{c}_g" for c in by})
    return rows.join(named, [rows[c].eqNullSafe(named[f"{c}_g"]) for c in by]).drop(*[f"{c}_g" for c in by])


def bucket(value: Column, edges: list[int]) -> Column:
    """The index of the half-open bucket that holds a value; the last has no end."""
    out = F.lit(None).cast("int")
    for k in range(len(edges)):
        out = F.when(value >= edges[k], k).otherwise(out) if k == 0 else F.when(value >= edges[k], F.lit(k)).otherwise(out)
    return out


def latency_summary(rows: DataFrame, by: list[str], latency: str, cost: str) -> DataFrame:
    """Groups with their number, latency percentiles and summed cost."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))
    found = percentiles(rows, by, latency, (50, 95))
    return sums.join(found, [sums[c].eqNullSafe(found[c]) for c in by], "left").select(*[sums[c] for c in by], "n", "p50", "p95", "cost")


def crossings(rows: DataFrame, latency: str, at: str, limits: list[int]) -> DataFrame:
    """For each limit: rows within it, their share, and the first step whose median exceeds it (0: none)."""
    steps = F.explode(F.array(*[F.lit(x) for x in limits])).alias("limit_ms")
    whole = rows.agg(F.count(latency).alias("n"), *[F.count_if(F.col(latency) <= x).alias(f"ok_{x}") for x in limits])
    medians = percentiles(rows, [at], latency, (50,))
    first = medians.agg(*[F.min(F.when(F.col("p50") > x, F.col(at))).alias(f"at_{x}") for x in limits])
    pick = lambda prefix: F.element_at(F.create_map(*[v for x in limits for v in (F.lit(x), F.col(f"{prefix}_{x}"))]), F.col("limit_ms"))
    # both sides are one row
    out = whole.crossJoin(first).select("*", steps)
    return out.select("limit_ms", pick("ok").alias("passed"), F.round(F.try_divide(pick("ok"), F.col("n")), 6).alias("pass_rate"), F.coalesce(pick("at"), F.lit(0)).alias("first_breach"))


def mean_or_nan(value: Column) -> Column:
    """The mean of a group; NaN where it has no values, as reports tell it."""
    return F.coalesce(F.avg(value), F.lit(float("nan")))


def in_report_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by columns, numbers that are texts by their size and before other texts, null last."""
    return rows.orderBy(*[c for name in columns for c in (F.col(name).cast("string").try_cast("double").asc_nulls_last(), F.col(name).asc_nulls_last())])


def within_budget(value: Column, limit: float) -> Column:
    """Whether a value that may be text is within the limit; what is no number isn't."""
    return F.coalesce(value.cast("string").try_cast("double") <= limit, F.lit(False))


def recommend(tokens: Column, window: Column, update_days: Column, attribution: Column, per_user: Column) -> Column:
    """Which architecture fits a corpus: the first rule that holds."""
    usage = tokens / window
    return F.when(attribution, "rag").when(per_user, "rag").when(usage > 0.70, "rag").when(update_days < 7, "rag").when((update_days > 90) & (usage < 0.30), "cag").otherwise("hybrid")


def ceilings(tokens: Column, window: Column, cost: Column, latency: Column) -> Column:
    """Names of the ceilings that a corpus breaks."""
    return F.array_compact(F.array(F.when(tokens / window > 0.70, "context"), F.when(cost > 0.05, "cost"), F.when(latency > 3000, "latency")))
