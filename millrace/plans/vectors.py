"""Queries over vectors: similarity, nearest entries, hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import caching
from .base import query, table

_PAIRS = "SELECT q.vec_id AS query_id, c.vec_id, q.label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0"


@query(f"SELECT query_id, vec_id, similarity, similarity >= 0.3 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM ({_PAIRS})) WHERE r = 1")
def semantic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "embeddings")
    return caching.nearest_in_bucket(cached.where("vec_id % 100 = 0"), cached, "label", 0.3)


@query(f"SELECT label, count(*) AS n, round(max(similarity), 6) AS most FROM ({_PAIRS}) GROUP BY label")
def cosine_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    pairs = caching.pairs_in_bucket(v.where("vec_id % 100 = 0"), v, "label")
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.max("similarity").alias("most"))


_REQUESTS = "(SELECT event_id AS request_id, user_id || ':' || event_type AS key, ts FROM events)"


@query(f"SELECT hit, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY key ORDER BY ts, request_id) > 1 AS hit FROM {_REQUESTS}) GROUP BY hit")
def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), "ts")
    return caching.exact_hits(e, "key", "ts").groupBy("hit").agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE r AS (SELECT key, request_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY key ORDER BY epoch(ts)::BIGINT, request_id) AS n FROM (SELECT request_id, key, date_trunc('second', ts) AS ts FROM {_REQUESTS})),
w AS (SELECT key, request_id, n, t AS since, false AS hit FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.request_id, r.n, CASE WHEN r.t < w.since + 86400 THEN w.since ELSE r.t END, r.t < w.since + 86400 FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
SELECT key, count(*) AS n, count(*) FILTER (hit) AS hits FROM w GROUP BY key
""")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), "ts")
    return caching.ttl_hits(e, "key", "ts").groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
