"""Queries over conversations: windows, anchors, merged facts, tiers, transcripts, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import documents, guardrails, needles, sessions
from .base import query, table

_ORDER = "PARTITION BY conv_id ORDER BY turn, role, text"
# Every third message states something that must not be forgotten.
_SAID = "(SELECT conv_id, turn, role, text || CASE WHEN (turn + conv_id) % 3 = 1 THEN ' The scope is frozen.' ELSE '' END AS text FROM conversations)"
_ANCHOR = r"(^|[^\p{L}\p{N}_])((scope|backlog)\s+(is\s+)?(frozen|locked|final|fixed)|nda|hipaa|gdpr|sox|fda)([^\p{L}\p{N}_]|$)"
# A turn is a question and the answer right after it; the oldest pair of more than two leaves the window as a whole.
PAIRS = f"""
said AS (SELECT * FROM {_SAID}),
m AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM said WHERE role IN ('user', 'assistant') WINDOW w AS ({_ORDER})),
p AS (SELECT conv_id, turn, question, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_matches(question, '{_ANCHOR}', 'i') AS anchored FROM m WHERE role = 'assistant' AND before = 'user'),
states AS (
  SELECT conv_id, turn, n AS turn_index, (2 * least(n, 2))::BIGINT AS messages_in_window, (2 * coalesce(sum(anchored::INT) OVER w, 0))::BIGINT AS anchors_count, greatest(n - 2, 0) AS evicted,
    greatest(least(coalesce(sum(CASE WHEN NOT anchored THEN least(length(question), 80) + 1 END) OVER w, 0) - 1, 2000), 0)::BIGINT AS summary_chars
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
ends AS (
  SELECT conv_id, max(n) AS turn_index, 2 * count(*) FILTER (recent) AS messages_in_window, 2 * count(*) FILTER (anchored AND NOT recent) AS anchors_count, greatest(max(n) - 2, 0) AS evicted,
    right(string_agg(left(question, 80), chr(10) ORDER BY n) FILTER (NOT recent AND NOT anchored), 2000) AS summary,
    string_agg('user: ' || question || chr(10) || 'assistant: ' || answer, chr(10) ORDER BY recent, n) FILTER (recent OR anchored) AS told
  FROM (SELECT *, n > max(n) OVER (PARTITION BY conv_id) - 2 AS recent FROM p) GROUP BY conv_id),
snapshots AS (SELECT conv_id, turn_index, messages_in_window, anchors_count, evicted, coalesce(length(summary), 0) AS summary_chars, summary,
  concat_ws(chr(10), CASE WHEN length(summary) > 0 THEN 'user: {sessions.ENVELOPE}' || chr(10) || summary END, told) AS messages FROM ends)
"""


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.when((F.col("turn") + F.col("conv_id")) % 3 == 1, " The scope is frozen.").otherwise("")))


@query(f"WITH {PAIRS} SELECT * FROM states")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.pair_states(sessions.pairs(said(spark, sf_dir)), 2)


@query(f"WITH {PAIRS} SELECT * FROM snapshots")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.snapshots(sessions.pairs(said(spark, sf_dir)), 2)


_LEADING = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, split_part(text, ' ', 1) AS w FROM conversations)"


@query(f"""
SELECT conv_id, n::INT AS n, last_value(CASE WHEN n % 3 = 1 THEN w END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS project FROM {_LEADING}
""")
def carried_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.numbered(table(spark, sf_dir, "conversations"))
    name = F.when(F.col("n") % 3 == 1, F.split_part("text", F.lit(" "), F.lit(1)))
    return rows.select("conv_id", "n", sessions.carried(name, "n").alias("project"))


@query(f"""
SELECT conv_id, string_agg(w, ',' ORDER BY n) AS words FROM (
  SELECT conv_id, w, n, row_number() OVER (PARTITION BY conv_id, lower(w) ORDER BY n) AS r FROM {_LEADING}) WHERE r = 1 GROUP BY conv_id
""")
def merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.numbered(table(spark, sf_dir, "conversations"))
    words = F.array_sort(F.collect_list(F.struct("n", F.split_part("text", F.lit(" "), F.lit(1)).alias("w"))))
    return rows.groupBy("conv_id").agg(words.alias("rows")).select("conv_id", F.array_join(sessions.union_words(F.transform("rows", lambda r: F.array(r["w"]))), ",").alias("words"))


_HINTS = "(SELECT conv_id, turn, role, text || CASE turn % 7 WHEN 0 THEN ' under NDA' WHEN 1 THEN ' needs HIPAA' WHEN 2 THEN ' with docker and kafka' WHEN 3 THEN ' docker docker' ELSE '' END AS text FROM conversations)"


@query(rf"""
SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])(nda|non[- ]?disclosure|confidential|under embargo|legal hold)([^\p{{L}}\p{{N}}_]|$)', 'i') THEN 'nda'
  WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])(hipaa|gdpr|rgpd|sox|pci[- ]?dss|fda|iso[- ]?27001|ccpa|lopd)([^\p{{L}}\p{{N}}_]|$)', 'i') THEN 'regulatory'
  WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])docker([^\p{{L}}\p{{N}}_]|$)', 'i') AND regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])kafka([^\p{{L}}\p{{N}}_]|$)', 'i') THEN 'technical'
  WHEN conv_id % 4 <= 2 AND conv_id % 4 > 0 THEN 'small_team' ELSE 'default' END AS rule
FROM {_HINTS}
""")
def tier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 7
    hint = F.when(k == 0, " under NDA").when(k == 1, " needs HIPAA").when(k == 2, " with docker and kafka").when(k == 3, " docker docker").otherwise("")
    df = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", hint))
    team = F.when(F.col("conv_id") % 4 > 0, F.col("conv_id") % 4)
    return df.select("conv_id", "turn", "role", guardrails.tier(F.col("text"), F.lit(""), F.array().cast("array<string>"), team)["rule"].alias("rule"))


_PRICES = "(VALUES ('gpt-4o-mini', 0.15::DOUBLE, 0.60::DOUBLE), ('gpt-4o', 2.50, 10.00), ('gpt-4', 10.0, 30.0)) AS p(prefix, price_in, price_out)"
_CALLS = "(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'openai/gpt-4o-mini-2024' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-4-turbo' ELSE 'other' END AS model, length(text) AS tokens_in, length(role) AS tokens_out FROM conversations)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    model = F.when(k == 0, "openai/gpt-4o-mini-2024").when(k == 1, "gpt-4o").when(k == 2, "gpt-4-turbo").otherwise("other")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), F.length("text").cast("long").alias("tokens_in"), F.length("role").cast("long").alias("tokens_out"))
    prices = spark.createDataFrame([("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00), ("gpt-4", 10.0, 30.0)], "prefix string, price_in double, price_out double")
    return sessions.costs(rows, prices)


@query(f"""
WITH priced AS (SELECT c.conv_id, c.turn, tokens_in, tokens_out, round((tokens_in * coalesce(price_in, 0) + tokens_out * coalesce(price_out, 0))::DECIMAL(20,4) * 0.000001::DECIMAL(7,6), 6)::DOUBLE AS cost
  FROM {_CALLS} c LEFT JOIN {_PRICES} ON prefix = CASE WHEN model LIKE '%gpt-4o-mini%' THEN 'gpt-4o-mini' WHEN model LIKE '%gpt-4o%' THEN 'gpt-4o' WHEN model LIKE '%gpt-4%' THEN 'gpt-4' END)
SELECT conv_id, turn, calls, tokens_in, tokens_out, cost_usd::DOUBLE AS cost_usd, (sum(cost_usd) OVER (PARTITION BY conv_id ORDER BY turn))::DOUBLE AS cumulative_usd
FROM (SELECT conv_id, turn, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost::DECIMAL(18,8)) AS cost_usd FROM priced GROUP BY conv_id, turn)
""")
def turn_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turn_totals(calls(spark, sf_dir))


@query("""
SELECT conv_id, 'turn-' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::VARCHAR, 4, '0') AS unit_key, role AS speaker FROM conversations
""")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.numbered(table(spark, sf_dir, "conversations"))
    line = F.concat(F.lit("[00:00:"), F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.lit("] "), "role", F.lit(": "), F.regexp_replace("text", r"[\r\n]+", " "))
    joined = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return documents.transcript_units(joined).select("conv_id", "unit_key", "speaker")


@query("""
SELECT conv_id, item_id, min(turn) AS first_turn FROM conversations, (SELECT item_id, split_part(text, ' ', 3) AS w FROM benchmark) WHERE contains(lower(text), lower(w)) GROUP BY conv_id, item_id
""")
def facts_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.split_part("text", F.lit(" "), F.lit(3))).alias("w"))
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn", "role").alias("key"), F.lower("text").alias("t"))
    met = needles.found_in(facts, turns, "w", "key", "t").join(facts, F.col("needle") == F.col("w"))
    return met.groupBy("key.conv_id", "item_id").agg(F.min("key.turn").alias("first_turn"))


@query("SELECT conv_id, turn, role, n::INT AS turn_index FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 3")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("turn_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    return rows.where("turn_index <= 3").select("conv_id", "turn", "role", "turn_index")
