"""The first rows of each group, without gathering groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps ``k`` rows a group in each task before the shuffle
    (a limit pushed below the window), so a large group doesn't meet in one task."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def first_values(rows: DataFrame, by: list[str], value: Column, k: int) -> DataFrame:
    """(by..., firsts): of each group the ``k`` smallest values in order, null left out."""
    few = first_k(rows.select(*by, value.alias("__value")).where("__value is not null"), by, [F.col("__value")], k)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list("__value")).alias("firsts"))
