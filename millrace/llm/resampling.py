"""Importance resampling towards a target distribution, by hashed runs of words.

Each document's features become an array of buckets by higher-order functions, written once. Buckets
are counted over all documents and over the target's texts (map-side sums: a task sends one total a
bucket), and the logarithm of the two smoothed distributions' ratio is a bucket's gain. The gains
are one array literal, over which every document's own array is folded; no feature is exploded or
shuffled for scores. Gumbel noise of the id turns the highest scores into a sample without
replacement; ranks come from a range-sorted table, whose ranges' sizes alone are put in order.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
GRAMS = 1
LEAST_WORDS = 20
SHARE = Fraction(10, 100)
SEED = "2024"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased: runs of digits, a-z and everything beyond ASCII. Null has none."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def features(found: Column, grams: int = GRAMS) -> Column:
    """All runs of 1 to ``grams`` consecutive words, joined by a space, repeats included."""

    def runs(g: int) -> Column:
        starts = F.when(F.size(found) >= g, F.sequence(F.lit(1), F.size(found) - (g - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, g), " "))

    return F.concat(found, *[runs(g) for g in range(2, grams + 1)]) if grams > 1 else found


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def _arrays(rows: DataFrame, text: str, grams: int, buckets: int) -> DataFrame:
    """``rows`` with ``n_words`` and ``found`` (buckets of all features) instead of the text."""
    rows = rows.withColumn("words", words(F.col(text)))
    return rows.select(*[c for c in rows.columns if c not in (text, "words")], F.size("words").cast("long").alias("n_words"), F.transform(features(F.col("words"), grams), lambda f: bucket(f, buckets)).alias("found"))


def _totals(arrays: DataFrame) -> DataFrame:
    """(bucket, n): how many features fall in each bucket. Tasks add up before anything is sent."""
    return arrays.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from two tables of totals (``buckets`` rows at most): how many thousandths
    of a natural logarithm likelier it is in the target. Every bucket has one added to its total."""
    ids = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = ids.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    everything = Window.partitionBy()  # over the table of buckets, whose size is a parameter
    real = lambda c: c.cast("double")
    ratio = real(F.col("t") + 1) * real(F.sum("s").over(everything) + buckets) / (real(F.col("s") + 1) * real(F.sum("t").over(everything) + buckets))
    rows = both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows)]


def sum_of_gains(found: Column, gains: list[int]) -> Column:
    """The sum of the gains of an array of buckets, looked up in one array literal."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")  # folded to a literal
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))


def floored_mean(total: Column, size: Column) -> Column:
    """total / size rounded down, in whole numbers; 0 if size is 0."""
    return F.when(size > 0, ((total - F.pmod(total, size)) / size).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(id_: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id in thousandths, floored: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``rows`` with ``place`` from 1 in the order of ``by``: sorted in ranges, of which only the sizes
    (a row for each) are put in order."""
    at = F.monotonically_increasing_id()
    rows = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at), "ranked")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("at") - F.shiftleft("range", 33)
    # one row for each partition of the sort
    placed = rows.join(F.broadcast(sizes.select("range", ahead.alias("ahead"))), "range")
    return placed.withColumn("place", F.col("ahead") + inside + 1).drop("range", "at", "ahead")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: Fraction = SHARE, seed: str = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank), a row for each row of ``docs``.

    ``weight`` is the floored mean gain of the row's features, ``score`` has the id's noise added. Of the
    N rows with ``least_words`` words or more, floor(``share`` * N) of the highest scores are drawn and
    ranked from 1, ties to the smaller id (null last, then by weight and size; rows that agree in all
    of these share out their ranks). Other rows have no rank.

    A null or empty text, and one without words, has no features and weight 0. A null id has noise of
    its own, one for all. Repeated rows count and are drawn each for itself. An empty target makes
    all buckets alike there; an empty table gives none. Whole texts are read, and only the columns named.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    arrays = cut(_arrays(rows, "text", grams, buckets), "buckets")
    gains = bucket_gains(_totals(arrays), _totals(_arrays(target.select(F.col(target_text).alias("text")), "text", grams, buckets)), buckets)
    summed = arrays.select("id", "n_words", F.size("found").cast("long").alias("n_features"), sum_of_gains(F.col("found"), gains).alias("total"))
    scored = summed.withColumn("weight", floored_mean(F.col("total"), F.col("n_features"))).drop("total")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * share.numerator // share.denominator
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc()]
    first = ranked(scored.where(able), order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = ["id", "n_features", "weight", "score", "rank"]
    return first.select(columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(columns))
