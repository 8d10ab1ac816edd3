"""Caches as tables: exact keys with a time to live, nearest vectors of a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import cosine
from ..sources.keyed import KeyedTable, latest
from ..sources.storage import Scope

TTL_SECONDS = 86_400
THRESHOLD = 0.85
#: Cached vectors of a bucket that meet a query at once.
BLOCK = 4096


def exact_hits(requests: DataFrame, key: str, at: str) -> DataFrame:
    """Requests with ``hit``: whether an equal key came before (no expiry)."""
    first = Window.partitionBy(key).orderBy(at, "request_id")
    return requests.withColumn("hit", F.row_number().over(first) > 1)


def ttl_hits(requests: DataFrame, key: str, at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Requests with ``hit`` under a time to live that a hit does not extend: an entry serves until
    ``ttl`` seconds after the miss that made it.

    The rule looks back to the last miss, but a request at least ``ttl`` after the one before is a
    miss whatever came earlier: it begins a segment. Requests are sorted in ranges of key and time, so
    segments are found by many tasks even for one key; only each range's last time and number of
    segments are put in order. Segments are passed in order of time, and only the last miss is kept.
    A request without a time is a miss.
    """
    rows = requests.select(F.col(key).alias("__key"), "request_id", F.col(at).cast("timestamp").cast("long").alias("__at"))
    order = ["__key", "__at", "request_id"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    path = Scope(requests.sparkSession, "cache").folder("sorted")  # the ranges' numbers must stay as they are
    sorted_.write.parquet(path)
    rows = requests.sparkSession.read.schema(sorted_.schema).parquet(path)
    ranges = Window.partitionBy("__key").orderBy("__range")  # over a row for each range of a key
    last = rows.groupBy("__key", "__range").agg(F.max("__at").alias("__last")).withColumn("__before", F.max("__last").over(ranges.rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("__key", "__range").orderBy("__at", "request_id")
    rows = _with_range(rows, last.drop("__last"))
    gap = F.col("__at") - F.coalesce(F.lag("__at").over(inside), F.col("__before"))
    rows = rows.withColumn("__first", F.coalesce(gap >= ttl, F.lit(True))).drop("__before")
    begun = rows.groupBy("__key", "__range").agg(F.count_if("__first").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.count_if("__first").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = _with_range(rows.withColumn("__upto", upto), begun.drop("__n")).withColumn("__segment", F.col("__upto") + F.col("__ahead"))
    rows = rows.repartition("__key", "__segment").sortWithinPartitions("__key", "__segment", "__at", "request_id", F.desc("__first"))
    schema = rows.select(F.col("__key").alias(key), "request_id").withColumn("hit", F.lit(True)).schema
    return rows.select(F.col("__key").alias(key), "request_id", "__at", "__first").mapInArrow(lambda batches: _pass(batches, ttl), schema)


def _with_range(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` with what ``told`` says of their key and range; null is a key."""
    named = told.withColumnsRenamed({"__key": "__k", "__range": "__r"})
    return rows.join(named, rows["__key"].eqNullSafe(named["__k"]) & (rows["__range"] == named["__r"])).drop("__k", "__r")


def _pass(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """(key, request_id, hit) of rows (key, request_id, at, first) by segment in order of time."""
    since = 0
    for batch in batches:
        n = batch.num_rows
        at = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        first = batch.column(3).to_numpy(zero_copy_only=False)
        hit = np.ones(n, bool)
        starts = np.flatnonzero(first)
        for a, b in zip(np.r_[0, starts], np.r_[starts, n], strict=True):
            k = a if a < b and first[a] else a + int(np.searchsorted(at[a:b], since + ttl))
            while k < b:
                hit[k], since = False, int(at[k])
                k = a + int(np.searchsorted(at[a:b], since + ttl))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit)], names=[*batch.schema.names[:2], "hit"])


def pairs_in_bucket(queries: DataFrame, cached: DataFrame, bucket: str, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, bucket, similarity) of all queries and cached vectors of one bucket, but a vector with itself.

    A large bucket's cached vectors are dealt over blocks of about ``block`` rows; a query meets
    every block of its bucket.
    """
    sizes = cached.groupBy(F.col(bucket).alias("b")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col(bucket).alias("b"), F.col("embedding").alias("q")).join(sizes, "b").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    c = cached.select("vec_id", F.col(bucket).alias("b"), F.col("embedding").alias("c")).join(sizes, "b").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    return q.join(c, ["b", "block"]).where("query_id <> vec_id").select("query_id", "vec_id", F.col("b").alias(bucket), F.round(cosine(F.col("q"), F.col("c")), 6).alias("similarity"))


def nearest_in_bucket(queries: DataFrame, cached: DataFrame, bucket: str, threshold: float = THRESHOLD, block: int = BLOCK, log_only: bool = False) -> DataFrame:
    """Each query's most similar cached vector of its bucket (ties: smallest id) and whether it is a hit
    (never if ``log_only``). The best of each block are combined."""
    pairs = pairs_in_bucket(queries, cached, bucket, block)
    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("vec_id", "similarity"), F.struct("similarity", (-F.col("vec_id")).alias("o"))).alias("m"))
    hit = F.lit(False) if log_only else F.col("m.similarity") >= threshold
    return best.select("query_id", "m.vec_id", "m.similarity", hit.alias("hit"))


class StoredCache:
    """A cache as a table: values by key, each until its end. Reading fails open: a cache that is gone or can't be
    read has no hits, and ``put`` makes it anew."""

    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL_SECONDS, value: str = "value string", by: str = "key", buckets: int = 64) -> None:
        self.spark, self.path, self.ttl, self.buckets = spark, path, ttl, buckets
        self.key, self.schema = by, f"{by} string, {value}, expires_at timestamp"

    def put(self, rows: DataFrame, at: Column) -> int:
        """Stores rows (key, value columns) made at a time; a key that is there already is replaced. Rows without
        a key are left out."""
        table = KeyedTable.create(self.spark, self.path, self.schema, [self.key], buckets=self.buckets)
        made = rows.where(F.col(self.key).isNotNull()).withColumn("expires_at", F.timestamp_seconds(F.unix_seconds(at.cast("timestamp")) + self.ttl))
        return table.upsert(made.select(*StructType.fromDDL(self.schema).names), latest([self.key], "expires_at"))

    def live(self, at: Column) -> DataFrame:
        """The entries that serve at a time."""
        try:
            rows = KeyedTable(self.spark, self.path).read()
        except (FileNotFoundError, ValueError, AnalysisException):
            rows = self.spark.createDataFrame([], self.schema)
        return rows.where(F.col("expires_at") > at.cast("timestamp"))

    def get(self, requests: DataFrame, at: Column) -> DataFrame:
        """``requests`` (key, ...) with the stored columns, null where there is no hit, and ``hit``."""
        found = self.live(at).withColumnRenamed(self.key, "__key").withColumn("hit", F.lit(True))
        out = requests.join(found, requests[self.key].cast("string") == F.col("__key"), "left").drop("__key", "expires_at")
        return out.withColumn("hit", F.coalesce("hit", F.lit(False)))

    def evict(self, at: Column) -> int:
        """Removes entries that have ended by a time, and files that nothing names any more."""
        table = KeyedTable.create(self.spark, self.path, self.schema, [self.key], buckets=self.buckets)
        ended = table.read().where(F.col("expires_at") <= at.cast("timestamp")).select(self.key)
        gone = table.remove(ended).count()
        table.vacuum()
        return gone
