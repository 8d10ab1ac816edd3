"""Mixing sources to target weights with a time-varying curriculum (DataFrame operations only).

Each source has a target number of words and a schedule, a piecewise linear weight over training
time t in [0, 1]. The weight's integral, scaled to the target, is the source's cumulative demand.
Its documents queue in a fixed pseudo-random order, once per pass over the source; the demand is
inverted at each document's place in the queue, which gives its training position, and the mix is
range-sorted by position.

The queue's running sums never gather a source in one task: rows are filed in hash buckets of
bounded size, summed by bucket, and only the sums of buckets are ordered per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, cut, fresh

#: Rows of one source bucket, on average.
BUCKET_ROWS = 2000
CYCLE = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: (time, weight): early training takes less, the end takes more; by the source's place in order.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), a row a source.

    Weights repeat ``cycle`` over sources by code point, null last. Together targets are ``share``
    of all words. A target stops at ``most`` times its source; what is over goes to the others by
    weight until none is above. That is one level L with target = min(L * weight, most * size): the
    sources are ordered by the level at which they stop, and L follows from running sums. Where
    all stop (``share`` >= ``most``), targets are ``most`` times the size. No rows give no rows.
    """
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.lit(most) * F.col("source_size")).withColumn("stop", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("stop", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level is right for the first source in order that it does not stop.
    leveled = ranked.withColumn("level", level).withColumn("free", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "place", "level"))).over(everything))
    target = F.when(F.col("free").isNull(), F.col("most")).otherwise(F.least(F.col("free.level") * F.col("weight"), F.col("most")))
    return leveled.select("source", "source_size", "place", target.alias("target"))


def _pieces(schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Per schedule its linear pieces with the share of the integral before them and in them."""
    rows = []
    for schedule in schedules:
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
        total, done, pieces = sum(areas), 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
            pieces.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("t0", t0), ("t1", t1), ("w0", w0), ("w1", w1), ("done", done / total), ("part", area / total))]))
            done += area
        rows.append(F.array(*pieces))
    return F.array(*rows)


def invert_demand(fraction: Column, place: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time by which a schedule has asked for ``fraction`` of its words (0 to 1)."""
    pieces = F.element_at(_pieces(schedules), (place % len(schedules) + 1).cast("int"))
    reached = F.filter(pieces, lambda p: p["done"] <= fraction)
    p = F.element_at(reached, -1)
    x = F.least(F.greatest((fraction - p["done"]) / p["part"], F.lit(0.0)), F.lit(1.0))
    # inside a piece the integral is quadratic: (w0 s + (w1 - w0) s^2 / 2) / ((w0 + w1) / 2) = x
    slope, area = p["w1"] - p["w0"], (p["w0"] + p["w1"]) / 2
    s = F.when(F.abs(slope) < 1e-12, x).otherwise((F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * area * x, F.lit(0.0))) - p["w0"]) / slope)
    return p["t0"] + (p["t1"] - p["t0"]) * F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: Sequence[int] = CYCLE, share: float = SHARE, most: float = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, th, size, source_size, target, passes, taken, positions), a row for each row of ``docs``.

    Pass k of a source begins where pass k-1 ended; a document belongs to the mix once for each
    pass in which its middle word lies before the source's target. So a source's words miss its
    target by less than one document, and a document is taken at most ceil(``most``) times.
    ``positions`` has a training time in [0, 1] for each time it is taken.

    Rows are queued by a hash of the id, or of the text where the id is null, so these spread alike.
    A null text has size 0, and size-0 documents are taken with the target not yet reached at their
    place (they add no words). A null source is a source of its own, last in order. Ties and
    repeated rows are ordered by hash, id and text hash; identical rows are interchangeable, and
    the reruns agree. An empty table gives none. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows.withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("th").cast("string")))).cast("binary"))), "mix")
    n = max(1, -(-rows.count() // bucket_rows))
    bits = (n - 1).bit_length()
    bucket = F.shiftright(F.conv(F.substring("order", 1, 15), 16, 10).cast("long"), 60 - bits)
    rows = rows.withColumn("bucket", bucket)
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    aims = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, share, most)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    buckets = buckets.withColumnRenamed("source", "source_b").withColumnRenamed("bucket", "bucket_b")
    aims = aims.withColumnRenamed("source", "source_a")
    placed = buckets.join(aims, F.col("source_b").eqNullSafe(F.col("source_a"))).drop("source_a")
    inner = Window.partitionBy("source", "bucket").orderBy("order", "id", "th").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    queued = queued.join(placed, queued["source"].eqNullSafe(placed["source_b"]) & (queued["bucket"] == placed["bucket_b"]))
    middle = F.col("ahead") + F.col("before") + F.col("size") / 2
    passes = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    offset = lambda k: middle + k * F.col("source_size")
    got = queued.withColumn("offsets", F.filter(F.transform(passes, offset), lambda o: o < F.col("target")))
    positions = F.transform("offsets", lambda o: invert_demand(F.when(F.col("target") > 0, o / F.col("target")).otherwise(F.lit(0.0)), F.col("place"), schedules))
    taken = F.size("offsets") * F.col("size")
    return got.select("id", "th", "size", "source_size", "target", F.size("offsets").alias("passes"), taken.cast("long").alias("taken"), positions.alias("positions"))


def training_order(plan: DataFrame) -> DataFrame:
    """(id, th, size, position, begin), a row for each time a row of ``plan`` is taken, range-sorted by
    training position (ties by id and text hash): ``begin`` is the number of words of the mix before it.

    The sorted mix is written with the number of its range; only the ranges' sums are ordered.
    """
    rows = plan.select("id", "th", "size", F.explode("positions").alias("position"))
    by = ["position", "id", "th"]
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id()), "mix-order")
    ranges = rows.groupBy("range").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition of the sort
    placed = rows.withColumn("inside", inside).join(F.broadcast(ranges.select("range", ahead.alias("ahead"))), "range")
    return placed.select("id", "th", "size", "position", (F.col("ahead") + F.col("inside")).alias("begin"))


def taken_in_order(plan: DataFrame) -> DataFrame:
    """(id, size, source_size, target, taken, first_position, last_position, first_begin, last_begin), a
    row for each row of ``plan``: what the range-sorted mix takes of it, where in training, and how
    many words of the mix come before. Rows that aren't taken have 0, and -1 for places; identical rows
    share out their places in order."""
    plan = cut(plan, "mix-plan")
    taken = training_order(plan)
    key = ["id", "th"]
    # Identical rows are interchangeable: they are numbered, and each has as many places as its passes.
    some = plan.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("positions")))
    taken = taken.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("position", "begin"))).drop("size").withColumnsRenamed({"id": "id_t", "th": "th_t", "place": "place_t"})
    until = F.sum("passes").over(Window.partitionBy(*key).orderBy("copy").rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("until", until).withColumnsRenamed({"id": "id_p", "th": "th_p"}).drop("taken", "positions")
    places = F.when(F.col("passes") > 0, F.sequence(F.col("until") - F.col("passes") + 1, F.col("until")))
    some = some.withColumn("place", F.explode_outer(places))
    met = some.join(taken, F.col("id_p").eqNullSafe(F.col("id_t")) & F.col("th_p").eqNullSafe(F.col("th_t")) & (F.col("place") == F.col("place_t")), "left")
    got = met.groupBy("id_p", "th_p", "copy", "size", "source_size", "target").agg(F.count("position").alias("times"), *[F.coalesce(f(c), F.lit(none)).alias(f"{n}_{c}") for c, none in (("position", -1.0), ("begin", -1)) for n, f in (("first", F.min), ("last", F.max))])
    return got.select(F.col("id_p").alias("id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "first_position", "last_position", "first_begin", "last_begin")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position_col: str | None = None, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, range-sorted by training
    position. Rows not taken are left out; the columns are those of ``docs``, and last the training
    position if ``position_col`` names it."""
    plan = plan_mix(docs, id_col, text_col, source_col, **options)
    id_, th, all_, n, k, at, id_p, th_p = fresh(docs, "mix_id", "mix_th", "mix_all", "mix_n", "mix_k", "mix_at", "mix_id_p", "mix_th_p")
    number = lambda by: F.row_number().over(Window.partitionBy(id_, th).orderBy(by))
    plan = plan.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("positions").alias(all_))
    plan = cut(plan.withColumn(n, number(all_)).where(F.size(all_) > 0), "mix-plan").withColumnsRenamed({id_: id_p, th: th_p})
    # Identical rows (equal id and text) are interchangeable: they are numbered on both sides and meet by number.
    rows = docs.withColumns({id_: F.col(id_col).cast("long"), th: F.xxhash64(F.col(text_col))}).withColumn(k, number(th))
    same = F.col(id_).eqNullSafe(F.col(id_p)) & (F.col(th) == F.col(th_p)) & (F.col(k) == F.col(n))
    out = rows.join(plan, same).withColumn(at, F.explode(all_))
    position = [F.col(at).alias(position_col)] if position_col else []
    return out.repartitionByRange(at, id_, th).sortWithinPartitions(at, id_, th).select(*docs.columns, *position)
