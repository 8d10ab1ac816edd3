"""Short texts looked for in many texts, by an index of letter runs instead of a loop over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bound

#: Letters of a run; shorter needles are found by runs of their own length.
RUN = 3


def runs(text: Column, length: int) -> Column:
    """The distinct runs of ``length`` characters of a text."""

    def of(letters: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(letters) - (length - 1))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(letters, i, length), "")))

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(F.length(text) >= length, bound(letters, lambda found: F.when(F.size(found) >= length, of(found)))).otherwise(F.array().cast("array<string>"))


def found_in(needles: DataFrame, texts: DataFrame, needle: str, key: str, text: str) -> DataFrame:
    """(key, needle): which needles each text contains. Keys name texts.

    Each needle is filed under the one of its runs that fewest texts have; texts meet needles by their
    runs, and what meets is verified. Only runs under which a needle is filed are shuffled. An empty
    or null needle is found nowhere. Case counts.
    """
    wanted = needles.select(F.col(needle).alias("needle")).where(F.length("needle") > 0).distinct().withColumn("length", F.least(F.length("needle"), F.lit(RUN)))
    per_length = lambda c: F.flatten(F.array(*[runs(c, n) for n in range(1, RUN + 1)]))
    parts = wanted.withColumn("run", F.explode(per_length(F.col("needle")))).where(F.length("run") == F.col("length")).drop("length")
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    # the alphabet bounds the number of runs; texts are told once a run
    used = parts.select("run").distinct()
    seen = rows.select("key", F.explode(per_length(F.col("text"))).alias("run")).join(used, "run", "left_semi")
    often = seen.groupBy("run").agg(F.count("*").alias("n"))
    filed = parts.join(often, "run").groupBy("needle").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count("*").alias("known"))
    # a needle with a run that no text has is nowhere
    total = parts.groupBy("needle").agg(F.count("*").alias("runs"))
    filed = filed.join(total, "needle").where("known = runs").select("needle", "run")
    met = seen.join(filed, "run").select("key", "needle")
    return met.join(rows, "key").where(F.contains("text", F.col("needle"))).select("key", "needle")
