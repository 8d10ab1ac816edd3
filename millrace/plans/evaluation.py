"""Queries of answer evaluation: orders as answers, line items as observed turns, conversations as memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .base import query, table

_STRUCTURE = """
SELECT o_orderkey, rows_hours AS sum_hours, round(rows_cost, 2) AS sum_cost, coalesce(hours_match::VARCHAR, 'unknown') AS hours_match, coalesce(cost_match::VARCHAR, 'unknown') AS cost_match,
  round(((k % 7 <> 0)::INT + (k % 5 <> 0)::INT + 1 + (k % 11 <> 0)::INT + (k % 3 <> 0)::INT + 1 + coalesce(hours_match, false)::INT + coalesce(cost_match, false)::INT + (k % 4 <> 0)::INT) / 9.0::DOUBLE, 3) AS score,
  array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'title' END, CASE WHEN k % 5 = 0 THEN 'table' END, CASE WHEN k % 11 = 0 THEN 'total_cost' END, CASE WHEN k % 3 = 0 THEN 'team' END, CASE WHEN NOT hours_match THEN 'hours_match' END, CASE WHEN NOT cost_match THEN 'cost_match' END, CASE WHEN k % 4 = 0 THEN 'finished' END], lambda x: x IS NOT NULL), ',') AS issues
FROM (SELECT *, CASE WHEN k % 5 <> 0 THEN k % 6 <> 0 END AS hours_match, CASE WHEN k % 5 <> 0 AND k % 11 <> 0 THEN k % 8 <> 0 END AS cost_match,
    CASE WHEN k % 5 <> 0 THEN h END AS rows_hours, CASE WHEN k % 5 <> 0 THEN c END AS rows_cost
  FROM (SELECT o_orderkey, o_orderkey AS k, sum(l_quantity)::DOUBLE AS h, sum(round(l_extendedprice * 100)::BIGINT) / 100.0::DOUBLE AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey))
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as estimates in Markdown, with faults that follow from the key."""
    line = F.concat(F.lit("| Part "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("long").cast("string"), F.lit(" | "), F.format_number(F.round("l_extendedprice", 2), 2), F.lit(" |"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("hours"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    k = F.col("l_orderkey")
    hours = F.col("hours") + F.when(k % 6 == 0, 5).otherwise(0)
    cost = F.format_number(F.col("cents") / 100.0 * F.when(k % 8 == 0, 1.1).otherwise(1.0), 2)
    text = F.concat_ws("\n", F.when(k % 7 != 0, "## Estimation: parts"), F.when(k % 5 != 0, "| Task | Hours | Cost |\n|---|---|---|"), F.array_join("lines", "\n"), F.concat(F.lit("**Total Estimated Hours: "), hours.cast("string"), F.lit("**")), F.when(k % 11 != 0, F.concat(F.lit("**Total Estimated Cost: "), cost, F.lit(" EUR**"))), F.when(k % 3 != 0, "**Recommended Team:** two"), F.lit("**Estimated Duration:** soon"))
    return rows.select(k.alias("o_orderkey"), text.alias("text"), F.when(k % 4 == 0, "length").otherwise("stop").alias("finish_reason"))


@query(_STRUCTURE)
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.structure(answers(spark, sf_dir))
    return got.select("o_orderkey", "sum_hours", "sum_cost", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("hours_match", "cost_match")], "score", F.array_join("issues", ",").alias("issues"))


_TURNS = """(SELECT l_linenumber AS turn, l_returnflag AS scenario, l_extendedprice / 5 AS latency_ms, l_extendedprice / 4 AS tokens_in, round(l_extendedprice * 100)::BIGINT / 1000000000.0::DOUBLE AS cost_usd, (l_quantity > 2 * l_linenumber)::INT::DOUBLE AS recall,
  CASE WHEN l_suppkey % 3 = 0 THEN (l_quantity > 5 * l_linenumber)::INT::DOUBLE END AS name_recall, (l_partkey % 2)::BIGINT AS stale_present, 1::BIGINT AS stale_total, l_linenumber * 5 AS size_kb, CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS rejected,
  CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'head=' || (l_partkey % 2) || ';middle=' || (l_partkey % 3 % 2) || ';tail=x' END AS detail, CASE WHEN l_linenumber > 2 THEN (l_partkey % 400)::BIGINT END AS summary_chars, (l_suppkey % 7)::BIGINT AS anchors, CASE l_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'none' END AS hit_kind FROM lineitem)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observed turns."""
    turn, price, part, supplier = F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")
    number = lambda c: c.cast("int").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        turn.alias("turn"), F.col("l_returnflag").alias("scenario"), (price / 5).alias("latency_ms"), (price / 4).alias("tokens_in"), (F.round(price * 100).cast("long") / 1000000000.0).alias("cost_usd"),
        number(F.col("l_quantity") > 2 * turn).alias("recall"), F.when(supplier % 3 == 0, number(F.col("l_quantity") > 5 * turn)).alias("name_recall"), (part % 2).cast("long").alias("stale_present"), F.lit(1).cast("long").alias("stale_total"), (turn * 5).alias("size_kb"), F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("rejected"),
        F.when(part % 10 == 0, "").otherwise(F.concat(F.lit("head="), (part % 2).cast("string"), F.lit(";middle="), (part % 3 % 2).cast("string"), F.lit(";tail=x"))).alias("detail"), F.when(turn > 2, (part % 400).cast("long")).alias("summary_chars"), (supplier % 7).cast("long").alias("anchors"), F.when(supplier % 4 == 0, "exact").when(supplier % 4 == 1, "semantic").otherwise("none").alias("hit_kind"),
    )


@query(f"""
SELECT turn, round(avg(recall) FILTER (scenario = 'A'), 3) AS "A", round(avg(recall) FILTER (scenario = 'N'), 3) AS "N", round(avg(recall) FILTER (scenario = 'R'), 3) AS "R", round(avg(name_recall), 3) AS name_recall, sum(stale_present)::BIGINT AS stale_present, sum(stale_total)::BIGINT AS stale_total
FROM {_TURNS} WHERE turn IN (1, 3, 6, 10, 20) GROUP BY turn
""")
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_by_turn(observed(spark, sf_dir), ["A", "N", "R"])


@query(f"""
SELECT size_kb, count(*) AS n, count(*) FILTER (rejected = 0) AS accepted, round(avg(tokens_in), 3) AS tokens_in, round(avg(cost_usd), 6) AS cost_usd, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
  round(avg(TRY_CAST(nullif(regexp_extract(detail, 'head=([^;]*)', 1), '') AS DOUBLE)), 2) AS head, round(avg(TRY_CAST(nullif(regexp_extract(detail, 'middle=([^;]*)', 1), '') AS DOUBLE)), 2) AS middle, NULL::DOUBLE AS tail FROM {_TURNS} GROUP BY size_kb
""")
def attachment_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attachment_table(observed(spark, sf_dir), ("head", "middle", "tail"))


_FIGURES = ", ".join(f"round(avg({c}) FILTER (turn = 1), 6) AS {c}_first, round(avg({c}) FILTER (turn = 7), 6) AS {c}_last, round(avg({c}) FILTER (turn = 7) / avg({c}) FILTER (turn = 1), 4) AS {c}_ratio" for c in ("latency_ms", "cost_usd", "tokens_in"))


@query(f"SELECT {_FIGURES}, max(coalesce(summary_chars, 0)) AS summary_most, count(*) FILTER (summary_chars > 0) AS summary_some, count(*) AS turns, max(anchors) AS anchors_most, (SELECT min(turn) FROM (SELECT turn, avg(name_recall) AS m FROM {_TURNS} GROUP BY turn) WHERE m < 0.6) AS name_lost_at FROM {_TURNS}")
def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.key_facts(observed(spark, sf_dir), 1, 7)


@query(f"SELECT scenario, size_kb, count(*) AS n, round(avg((hit_kind = 'exact')::INT), 6) AS exact_rate, round(avg((hit_kind = 'semantic')::INT), 6) AS semantic_rate, round(avg(recall), 6) AS recall FROM {_TURNS} GROUP BY scenario, size_kb")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_summary(observed(spark, sf_dir), ["scenario", "size_kb"])


# Facts of a conversation: needles with aliases; the second is superseded.
FACTS = [("greeting", "persist", ("thank", "please")), ("old_plan", "superseded", ("the ",)), ("topic", "persist", ("what", "how", "why")), ("number", "persist", ("1", "2", "3"))]
_FACTS = " UNION ALL ".join(f"SELECT conv_id, '{k}' AS key, '{e}' AS expectation, list_bool_or(list_transform([{', '.join(repr(n) for n in needles)}], lambda n: contains(lower(hay), n))) AS recalled FROM h" for k, e, needles in FACTS)


@query(f"""
WITH h AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS hay FROM conversations GROUP BY conv_id), f AS ({_FACTS})
SELECT conv_id, round(avg(recalled::INT) FILTER (expectation = 'persist'), 4) AS memory, count(*) FILTER (expectation = 'persist') AS persist_total, count(*) FILTER (expectation = 'persist' AND recalled) AS persist_recalled, count(*) FILTER (expectation = 'superseded') AS stale_total, count(*) FILTER (expectation = 'superseded' AND recalled) AS stale_present,
  string_agg(key || '=' || recalled::INT, ';' ORDER BY key) AS detail FROM f GROUP BY conv_id
""")
def memory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    hay = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("hay"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(e).alias("expectation"), evaluation.recalled(F.col("hay"), F.array(*[F.lit(n) for n in needles])).alias("recalled")) for k, e, needles in FACTS]))
    return evaluation.memory_scores(hay.select("conv_id", each.alias("f")).select("conv_id", "f.*"), "conv_id")


_LINES = "SELECT l_orderkey AS o, l_linenumber AS turn, l_linenumber AS introduced_at, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber + l_partkey % 3 + 1 END AS superseded_at FROM lineitem"


@query(f"SELECT t.o AS l_orderkey, t.turn, count(*) AS facts FROM ({_LINES}) t JOIN ({_LINES}) f ON t.o = f.o AND f.introduced_at <= t.turn AND (f.superseded_at IS NULL OR f.superseded_at > t.turn) GROUP BY t.o, t.turn")
def live_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    facts = lines.select("l_orderkey", F.col("l_partkey").cast("string").alias("key"), F.col("l_linenumber").alias("introduced_at"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber") + F.col("l_partkey") % 3 + 1).alias("superseded_at"))
    turns = lines.select("l_orderkey", F.col("l_linenumber").alias("turn"))
    return evaluation.live_facts(facts, turns, "l_orderkey").groupBy("l_orderkey", "turn").agg(F.count("*").alias("facts"))


@query("SELECT l_returnflag AS scenario, size_kb, repeat, count(*) FILTER (l_linenumber - 1 = repeat) AS runs FROM lineitem, (SELECT unnest([0, 5, 20, 50, 100]) AS size_kb), (SELECT unnest([0, 1, 2]) AS repeat) GROUP BY ALL")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(F.col("l_linenumber") - 1 == r).alias(f"runs_{r}") for r in range(3)])
    # a scenario for each flag
    grid = rows.select("*", F.explode(evaluation.sweep(["all"], [0, 5, 20, 50, 100], 3)).alias("g"))
    runs = F.element_at(F.array(*[F.col(f"runs_{r}") for r in range(3)]), F.col("g.repeat") + 1)
    return grid.select(F.col("l_returnflag").alias("scenario"), "g.size_kb", "g.repeat", runs.alias("runs"))


@query(f"SELECT scenario, round(avg(recall), 6) AS recall_score, avg(recall) >= 0.5 AS recall_passed, round(avg(name_recall), 6) AS name_score, avg(name_recall) >= 0.5 AS name_passed FROM {_TURNS} GROUP BY scenario")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir)
    means = rows.groupBy("scenario").agg(F.avg("recall").alias("recall"), F.avg("name_recall").alias("name"))
    long = means.select("scenario", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("mean")) for n in ("recall", "name")])).alias("m"))
    return evaluation.as_row(long.select("scenario", "m.name", F.round("m.mean", 6).alias("score"), (F.col("m.mean") >= 0.5).alias("passed")), "scenario", ["recall", "name"])


@query("""
SELECT o_orderkey, array_to_string(list_filter(list_concat([o_orderstatus], flatten(list(CASE WHEN l_linenumber % 2 = 0 THEN ['', l_linestatus] ELSE ['phase ' || l_linenumber, l_returnflag] END ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus))), lambda x: x <> ''), chr(10)) AS answer FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
""")
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.lit("").alias("name"), F.col("l_linestatus").alias("summary"))).otherwise(F.struct(F.concat(F.lit("phase "), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("summary")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", phase.alias("phase")))).alias("rows"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", evaluation.answer_text(F.col("o_orderstatus"), F.transform("rows", lambda r: r["phase"])).alias("answer"))
