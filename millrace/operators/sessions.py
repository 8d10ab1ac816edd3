"""Conversations as tables: windows of turns, anchors, merged facts, costs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guardrails import is_anchor

#: Pairs of question and answer that a session's window holds.
WINDOW = 6
#: Characters of a pair's line in the summary, and of the whole summary.
LINE_CHARS, SUMMARY_CHARS = 80, 2000
#: Marks the summary among the messages as what was said before.
ENVELOPE = "[Summary of what was said before the turns below]"


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with a dense number from 1 in each conversation."""
    return turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, n, turn, question, answer, anchored): a question and the answer right after it, numbered
    from 1 in each conversation. Messages of other roles are looked through; a question without an
    answer, and an answer without a question, are no pair. ``anchored``: the question is one to keep, by the
    rules or by a column ``judged`` where it isn't null."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = turns.where(F.col("role").isin("user", "assistant") & F.col("conv_id").isNotNull())
    said = said.withColumns({"before": F.lag("role").over(order), "question": F.coalesce(F.lag("text").over(order), F.lit(""))})
    judged = None
    if "judged" in turns.columns:
        said, judged = said.withColumn("judged", F.lag("judged").over(order)), F.col("judged")
    found = said.where("role = 'assistant' and before = 'user'").withColumn("n", F.row_number().over(order))
    return found.select("conv_id", "n", "turn", "question", F.coalesce("text", F.lit("")).alias("answer"), is_anchor(F.col("question"), judged).alias("anchored"))


def pair_states(found: DataFrame, size: int = WINDOW) -> DataFrame:
    """After each pair: messages in the window (the last ``size`` pairs), messages kept as anchors, pairs
    that have left, and the length of the summary of those that aren't anchors."""
    past = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -size)
    so_far = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0)).cast("long")
    line = F.when(~F.col("anchored"), F.least(F.length("question"), F.lit(LINE_CHARS)) + 1)
    counts = {"messages_in_window": 2 * F.least("n", F.lit(size)).cast("long"), "anchors_count": 2 * so_far(F.col("anchored").cast("long")), "evicted": F.greatest(F.col("n") - size, F.lit(0)).cast("long")}
    rows = found.withColumns(counts | {"__chars": so_far(line)})
    return rows.select("conv_id", "turn", F.col("n").cast("long").alias("turn_index"), *counts, F.greatest(F.least(F.col("__chars") - 1, F.lit(SUMMARY_CHARS)), F.lit(0)).cast("long").alias("summary_chars"))


def snapshots(found: DataFrame, size: int = WINDOW) -> DataFrame:
    """The state at each conversation's end: counters, summary, and the list of messages for the next call,
    which is the summary (marked as such), the anchors in order, then the window.

    Only what is in the list is collected: the window, the anchors, and of the summary the last lines.
    """
    last = found.groupBy("conv_id").agg(F.max("n").alias("last"))
    rows = found.join(last, "conv_id").withColumn("recent", F.col("n") > F.col("last") - size)
    plain = rows.where(~F.col("recent") & ~F.col("anchored"))
    end = Window.partitionBy("conv_id").orderBy(F.desc("n"))
    lines = plain.withColumn("back", F.row_number().over(end)).where(F.col("back") <= SUMMARY_CHARS + 1)
    lines = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", F.left("question", F.lit(LINE_CHARS)).alias("line")))).alias("lines"))
    summary = lines.select("conv_id", F.right(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(SUMMARY_CHARS)).alias("summary"))
    kept = rows.where(F.col("recent") | F.col("anchored"))
    told = F.array_sort(F.collect_list(F.struct(F.col("recent").cast("int").alias("rank"), "n", F.concat(F.lit("user: "), "question", F.lit("\nassistant: "), "answer").alias("text"))))
    kept = kept.groupBy("conv_id").agg(F.max("last").cast("long").alias("turn_index"), (2 * F.count_if("recent")).alias("messages_in_window"), (2 * F.count_if(~F.col("recent"))).alias("anchors_count"), F.transform(told, lambda x: x["text"]).alias("told"))
    both = kept.join(summary, "conv_id", "left")
    envelope = F.when(F.length("summary") > 0, F.concat(F.lit(f"user: {ENVELOPE}\n"), "summary"))
    return both.select("conv_id", "turn_index", "messages_in_window", "anchors_count", F.greatest(F.col("turn_index") - size, F.lit(0)).alias("evicted"), F.coalesce(F.length("summary"), F.lit(0)).cast("long").alias("summary_chars"), "summary", F.array_join(F.array_compact(F.concat(F.array(envelope), "told")), "\n").alias("messages"))


def carried(value: Column, *order: str, by: str = "conv_id") -> Column:
    """The last value so far that says something: not null, not empty, and of numbers not 0."""
    return F.last(F.when(~value.cast("string").isin("", "0", "0.0"), value), ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def union_words(lists: Column) -> Column:
    """Words of a list of lists, first spelling first, each once regardless of case."""
    return F.aggregate(F.flatten(lists), F.array().cast("array<string>"), lambda seen, w: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(w)), seen).otherwise(F.concat(seen, F.array(w))))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, tokens_in, tokens_out, ...) with the price of the longest known prefix of the model
    (0 if none) and their cost. The price list is a small dimension."""
    named = calls.withColumn("bare", F.regexp_replace("model", "^[^/]+/", ""))
    models = named.select("bare").distinct()
    found = models.join(prices, F.startswith("bare", F.col("prefix"))).groupBy("bare").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("price"))
    out = named.join(found, "bare", "left")
    price = lambda f: F.coalesce(F.col(f"price.{f}"), F.lit(0.0))
    return out.withColumn("cost_usd", F.round((F.col("tokens_in") * price("price_in") + F.col("tokens_out") * price("price_out")).cast("decimal(20,4)") * F.lit(Decimal("0.000001")), 6).cast("double")).drop("bare", "price")


def turn_totals(calls: DataFrame) -> DataFrame:
    """One row for each turn, and the cost of the conversation so far."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    exact = F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0)).cast("decimal(18,8)"))
    turns = calls.groupBy("conv_id", "turn").agg(F.count("*").alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), exact.alias("cost_usd"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("cumulative_usd", F.sum("cost_usd").over(so_far).cast("double")).withColumn("cost_usd", F.col("cost_usd").cast("double"))


def provider(model: Column) -> Column:
    """Who serves a model: what is before its slash, else told by its name; null if neither says."""
    bare = F.lower(F.substring_index(model, "/", -1))
    named = F.when(bare.rlike("^(gpt|o[0-9]|text-embedding)"), "openai").when(F.startswith(bare, F.lit("claude")), "anthropic").when(F.startswith(bare, F.lit("gemini")), "google")
    return F.when(F.contains(model, F.lit("/")), F.lower(F.substring_index(model, "/", 1))).otherwise(named)


def union_exact(lists: Column) -> Column:
    """Items of a list of lists, each once, in the order in which they first came. Case counts; nulls are left out."""
    return F.array_compact(F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull()))))


def metadata_json(name: Column, team: Column, technologies: Column, scope: Column, constraints: Column, rejected: Column) -> Column:
    """What is known of a project as one JSON text, in which facts are looked for whatever field they are in."""
    fields = {"project_name": name, "assumed_team_size": team, "mentioned_technologies": technologies, "agreed_scope": scope, "explicit_constraints": constraints, "rejected_options": rejected}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def facts_text(facts: Column) -> Column:
    """A list of facts as the text in which they are looked for: a JSON array, but with control characters (the line
    ends that words may hold) as they were said. Escaped, such a fact wouldn't be found; nulls are left out."""
    plain = F.transform(F.array_compact(facts), lambda w: F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    return F.concat(F.lit('["'), F.array_join(plain, '","'), F.lit('"]'))


OBSERVED = ["session_id", "turn_index", "enriched_transcript_chars", "attachments_total_chars", "messages_in_window", "anchors_count", "summary_chars", "tokens_in", "tokens_out", "cost_usd", "latency_ms", "cache_hit_kind", "last_resolved_tier", "llm_calls", "llm_latency_ms", "model", "attachments_count", "attachments_rejected"]


def turn_observed(found: DataFrame, calls: DataFrame, attached: DataFrame, size: int = WINDOW) -> DataFrame:
    """The 18 columns of ``OBSERVED``, a row for each pair of ``pairs`` (with ``tier`` and ``latency_ms``): the state of its
    session after it, its calls (conv_id, turn, place, model, tokens_in, tokens_out, cost_usd, latency_ms) added up, the model
    of the first, and its attachments (conv_id, turn, chars, ok). Sessions don't use caches, which the row says."""
    exact = F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0)).cast("decimal(18,8)")).cast("double")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    spent = calls.groupBy("conv_id", "turn").agg(F.count("*").alias("llm_calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), exact.alias("cost_usd"), total("latency_ms").alias("llm_latency_ms"), F.min_by("model", "place").alias("model"))
    files = attached.groupBy("conv_id", "turn").agg(F.count("*").alias("attachments_count"), F.count_if(~F.col("ok")).alias("attachments_rejected"), total("chars").alias("attachments_total_chars"))
    said = found.select("conv_id", "turn", "tier", "latency_ms", F.length("question").cast("long").alias("chars"))
    rows = pair_states(found, size).join(said, ["conv_id", "turn"]).join(spent, ["conv_id", "turn"], "left").join(files, ["conv_id", "turn"], "left")
    rows = rows.fillna(0, ["llm_calls", "tokens_in", "tokens_out", "cost_usd", "llm_latency_ms", "attachments_count", "attachments_rejected", "attachments_total_chars"])
    rows = rows.withColumns({"session_id": F.col("conv_id").cast("string"), "enriched_transcript_chars": F.col("chars") + F.col("attachments_total_chars"), "cache_hit_kind": F.lit("none"), "last_resolved_tier": F.col("tier")})
    return rows.select(*OBSERVED)
