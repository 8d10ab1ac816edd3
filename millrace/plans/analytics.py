"""Queries of evaluation analytics over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..streaming import events as streams
from .base import query, table


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(sum(value), 6) AS cost FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value", "value")


@query("SELECT CASE WHEN t >= 9000 THEN 5 WHEN t >= 6500 THEN 4 WHEN t >= 5500 THEN 3 WHEN t >= 4500 THEN 2 WHEN t >= 3500 THEN 1 ELSE 0 END AS bucket, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50 FROM (SELECT l_extendedprice / 4 AS t, l_quantity FROM lineitem) GROUP BY 1")
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("bucket", analytics.bucket(F.col("l_extendedprice") / 4, analytics.TOKEN_BUCKETS))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(analytics.percentiles(rows, ["bucket"], "l_quantity", (50,)), "bucket")


@query("SELECT l_linenumber, round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 6) AS \"A\", round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 6) AS \"N\", round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 6) AS \"R\" FROM lineitem WHERE l_linenumber IN (1, 3, 6) GROUP BY l_linenumber")
def cost_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").isin(1, 3, 6))
    return rows.groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_extendedprice"), 6))


@query("""
SELECT limit_ms, passed, pass_rate, coalesce(breach, 0)::INT AS first_breach FROM (SELECT limit_ms, (SELECT count(*) FROM lineitem WHERE l_extendedprice / 5 <= limit_ms) AS passed, round((SELECT count(*) FROM lineitem WHERE l_extendedprice / 5 <= limit_ms)::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS pass_rate,
  (SELECT min(l_linenumber) FROM (SELECT l_linenumber, quantile_disc(l_extendedprice / 5, 0.5) AS p50 FROM lineitem GROUP BY l_linenumber) WHERE p50 > limit_ms) AS breach
FROM (SELECT unnest([4000, 6000, 8000, 10000, 15000]) AS limit_ms))
""")
def sla_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_extendedprice") / 5).alias("ms"))
    return analytics.crossings(rows, "ms", "l_linenumber", analytics.LIMITS)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.regr_count("l_extendedprice", "l_quantity").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'rag' WHEN p_size % 11 = 0 THEN 'rag' WHEN p_retailprice / 2500 > 0.7 THEN 'rag' WHEN p_size < 7 THEN 'rag' WHEN p_size > 40 AND p_retailprice / 2500 < 0.3 THEN 'cag' ELSE 'hybrid' END AS choice FROM part
""")
def architecture_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    days = F.when(size > 40, 91).otherwise(size)
    return table(spark, sf_dir, "part").select("p_partkey", analytics.recommend(F.col("p_retailprice"), F.lit(2500), days, size % 7 == 0, size % 11 == 0).alias("choice"))


@query("SELECT coalesce(o_orderpriority, 'TOTAL') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderpriority", F.lit("TOTAL")).alias("priority"), "n", "total")


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(spark, f"{sf_dir}/events.parquet")


@query("""
SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) WHERE new = 1 GROUP BY user_id
""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.counts(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_type, strftime(day - to_days(k), '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) AS day FROM events), (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(streams.read_events(spark, f"{sf_dir}/events.parquet"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    got = streams.without_repeats(streams.in_order(spark, e, e.where("event_id % 2 = 0")))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    late = e.withColumn("ts", F.col("ts") - F.expr("interval 400 days"))
    # What is late is judged by the watermark of the batch before the last.
    half = F.lit("2024-01-16").cast("timestamp")
    return streams.daily_without_late(streams.in_order(spark, e.where(F.col("ts") < half), e.where(F.col("ts") >= half), late))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "ts", "value")
    newer = e.where("event_id % 3 = 0").withColumns({"ts": F.col("ts") + F.expr("interval 1 hour"), "value": F.col("value") + 1})
    return streams.upserted(streams.in_order(spark, e, newer), "event_id", "ts").select("event_id", "value")


@query("""
SELECT conv_id, turn, role, n AS turn_index, least(n, 6) AS in_window, (sum(contains(text, '?')::INT) OVER w)::BIGINT AS anchors, last_value(lang IGNORE NULLS) OVER w AS known
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN left(text, 3) END AS lang, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY n)
""")
def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("lang", F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(3))))
    c = c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "lang")
    return streams.session_turns(streams.in_order(spark, c.where("turn < 4"), c.where("turn >= 4")))


@query("SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn, role, text) AS text FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id")
def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    deltas = rows.select(F.col("conv_id").alias("stream_id"), F.struct("turn", "role", "text").alias("seq"), F.col("text").alias("delta"), (F.col("conv_id") % 5 != 0).alias("done"))
    return streams.assembled(deltas)
