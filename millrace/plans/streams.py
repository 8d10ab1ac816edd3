"""Queries over streams with typed state; each is fed in parts and goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import Scope
from ..streaming import caches, deltas
from ..streaming import sessions as streams
from ..streaming.state import fed, feed, run_on
from .base import query, table
from .conversations import PAIRS, said


def in_two_runs(spark: SparkSession, parts: list[DataFrame], stream) -> DataFrame:
    """Runs ``stream`` (of a streaming table) over the first part, then again from its checkpoint over each of the
    others: a part is one micro-batch, of any number of files. Only before the last part and after it time passes by
    itself, so that rows of the others aren't late for each other."""
    scope = Scope(spark, "stream")
    folder, schema = scope.folder("in"), parts[0].schema
    for k, part in enumerate(parts):
        feed(part, folder, k)
        out = run_on(stream(fed(spark, folder, schema)), scope.folder("out"), scope.folder("state"), settle=k >= len(parts) - 2)
    return out


_REQUESTS = "(SELECT event_id AS request_id, user_id || ':' || event_type AS key, ts FROM events)"


@query(f"""
WITH RECURSIVE r AS (SELECT key, request_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) AS n FROM {_REQUESTS}),
w AS (SELECT key, request_id, n, t AS since, false AS hit FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.request_id, r.n, CASE WHEN r.t < w.since + 86400000000 THEN w.since ELSE r.t END, r.t < w.since + 86400000000 FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
SELECT key, request_id, hit FROM w
""")
def stream_exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    parts = [e.where(F.col("ts") < day(9)), e.where((F.col("ts") >= day(9)) & (F.col("ts") < day(17))), e.where(F.col("ts") >= day(17))]
    return in_two_runs(spark, parts, lambda s: caches.exact_hits(s, "key", "ts", 86_400))


# A request is judged by the entries that live: misses of the last four days in its bucket.
@query("""
WITH RECURSIVE r AS (SELECT label, vec_id, epoch_us(ts) AS t, list_transform(embedding, lambda c: c::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY ts, vec_id) AS n FROM embeddings JOIN events ON event_id = vec_id),
w AS (
  SELECT label, n, vec_id, NULL::STRUCT(s DOUBLE, id BIGINT) AS best, [{t: t, id: vec_id, v: v}] AS entries FROM r WHERE n = 1
  UNION ALL
  SELECT label, n, vec_id, best, CASE WHEN best.s >= 0.25 THEN live ELSE list_append(live, {t: t, id: vec_id, v: v}) END
  FROM (SELECT *, list_sort(list_transform(live, lambda e: {s: -list_cosine_similarity(e.v, v), id: e.id}))[1] AS lo, CASE WHEN lo IS NOT NULL THEN {s: -struct_extract(lo, 's'), id: struct_extract(lo, 'id')} END AS best
    FROM (SELECT r.*, list_filter(w.entries, lambda e: e.t + 345600000000 > r.t) AS live FROM w JOIN r ON r.label = w.label AND r.n = w.n + 1)))
SELECT label::VARCHAR AS bucket, vec_id AS request_id, coalesce(best.s >= 0.25, false) AS hit, coalesce(best.id, -1) AS cached_id, coalesce(round(best.s, 6), -2.0::DOUBLE) AS similarity FROM w
""")
def stream_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), "label", "embedding").join(e, "request_id")
    half = v.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.timestamp_micros(((F.unix_micros("a") + F.unix_micros("b")) / 2).cast("long")).alias("half"))
    v = v.crossJoin(F.broadcast(half))  # one row
    parts = [v.where(F.col("ts") < F.col("half")).drop("half"), v.where(F.col("ts") >= F.col("half")).drop("half")]
    got = in_two_runs(spark, parts, lambda s: caches.vector_hits(s, "label", "ts", "embedding", ttl=345_600, threshold=0.25))
    return got.withColumns({"cached_id": F.coalesce("cached_id", F.lit(-1)), "similarity": F.coalesce("similarity", F.lit(-2.0))})


def _messages(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Messages with a time and with what an extractor has told; the last part only lets time pass."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("turn") + F.col("conv_id") % 60)
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    m = said(spark, sf_dir).select(F.col("conv_id").cast("long").alias("conv_id"), at.alias("at"), F.col("turn").cast("long").alias("turn"), "role", "text", F.when(F.col("turn") % 4 == 0, word(1)).alias("project"), F.array(word(1), word(2)).alias("technologies"))
    later = m.where("turn = 0").limit(1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("at") + F.expr("interval 2 days"), "turn", F.lit("system"), "text", "project", "technologies")
    return [m.where("turn < 4"), m.where("turn >= 4"), later.toDF(*m.columns)]


_FACTS = "facts AS (SELECT conv_id, turn, last_value(CASE WHEN turn % 4 = 0 THEN nullif(split_part(text, ' ', 1), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS project FROM said)"


@query(f"WITH {PAIRS}, {_FACTS} SELECT conv_id, turn_index, messages_in_window, anchors_count, evicted, summary_chars, project FROM states JOIN facts USING (conv_id, turn)")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = in_two_runs(spark, _messages(spark, sf_dir)[:2], lambda s: streams.session_states(s, 2))
    return got.where("kind = 'turn'").drop("kind", "technologies", "messages")


@query(f"""
WITH {PAIRS}, {_FACTS}, words AS (
  SELECT conv_id, string_agg(w, ',' ORDER BY turn, i) AS technologies FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, lower(w) ORDER BY turn, i) AS r FROM (SELECT conv_id, turn, i, split_part(text, ' ', i) AS w FROM said, (SELECT unnest([1, 2]) AS i)) WHERE w <> '') WHERE r = 1 GROUP BY conv_id)
SELECT conv_id, turn_index, messages_in_window, anchors_count, evicted, summary_chars, (SELECT max_by(project, turn) FROM facts f WHERE f.conv_id = s.conv_id) AS project, technologies, messages
FROM snapshots s JOIN words USING (conv_id)
""")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = in_two_runs(spark, _messages(spark, sf_dir), lambda s: streams.session_states(s, 2))
    return got.where("kind = 'ended' and turn_index > 0").drop("kind")


_NUMBERED = "(SELECT *, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"


# Odd deltas first, then the others and each third one again; every fifth stream has no end mark, every seventh lacks its second delta.
@query(f"""
SELECT conv_id AS stream_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (conv_id % 7 <> 0 OR seq < 1), '') AS text, count(*) FILTER (conv_id % 7 <> 0 OR seq < 1) AS deltas,
  count(*) FILTER (seq % 3 = 0)::BIGINT AS repeats, conv_id % 5 <> 0 AND conv_id % 7 <> 0 AS complete FROM {_NUMBERED} GROUP BY conv_id
""")
def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumns({"seq": (F.row_number().over(order) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("conv_id"))})
    rows = rows.select(F.col("conv_id").cast("long").alias("stream_id"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("at"), "seq", F.col("text").alias("delta"), ((F.col("seq") == F.col("n") - 1) & (F.col("conv_id") % 5 != 0)).alias("done"))
    rows = rows.where("stream_id % 7 <> 0 or seq <> 1")
    again = rows.where("seq % 3 = 0").withColumn("at", F.col("at") + F.expr("interval 1 minute"))
    later = rows.where("seq = 0").limit(1).select(F.lit(-1).cast("long").alias("stream_id"), F.col("at") + F.expr("interval 2 days"), "seq", "delta", F.lit(False))
    # the repeats follow in a part of their own before the last numbers, or a text would be told before them
    parts = [rows.where("seq % 2 = 1 and not done"), rows.where("seq % 2 = 0 and not done").union(again.where("not done")), rows.where("done").union(again.where("done")), later.toDF(*rows.columns)]
    return in_two_runs(spark, parts, lambda s: deltas.assembled_stream(s, idle_ms=3_600_000))
