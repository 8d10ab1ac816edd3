"""Evaluation of answers: structure and declared totals, recall by turn, attachments, key facts, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import percentiles

# What a complete answer holds.
TITLE = r"(?m)^\s*##\s+\S"
HEADER = r"(?i)\|\s*Task\s*\|\s*Hours\s*\|\s*Cost"
ROW = r"(?m)^ *\| *([^|\n]+) *\| *([\d.,]+) *\| *([\d.,]+) *\| *$"
TOTAL_HOURS = r"(?i)\*\*Total Estimated Hours:\s*([\d.,]+)"
TOTAL_COST = r"(?i)\*\*Total Estimated Cost:\s*([\d.,]+)"
TEAM = r"(?i)\*\*Recommended Team:"
DURATION = r"(?i)\*\*Estimated Duration:"
HOURS_APART, COST_APART, FINISHED = 1.0, 0.02, ("stop",)
LADDER = (1, 3, 6, 10, 20)


def number(text: Column) -> Column:
    """1,234.5 as double; null if it is no number."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def table_sums(text: Column) -> Column:
    """(rows, hours, cost) of the lines of a task table; the heading isn't one of them."""
    column = lambda k: F.regexp_extract_all(text, F.lit(ROW), F.lit(k))
    lines = F.filter(F.zip_with(column(1), F.zip_with(column(2), column(3), lambda h, c: F.struct(number(h).alias("hours"), number(c).alias("cost"))), lambda t, v: F.struct(F.lower(F.trim(t)).alias("task"), v["hours"].alias("hours"), v["cost"].alias("cost"))), lambda r: (r["task"] != "task") & r["hours"].isNotNull() & r["cost"].isNotNull())
    total = lambda rows, name: F.round(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r[name]), 2)
    return F.element_at(F.transform(F.array(lines), lambda rows: F.struct(F.size(rows).alias("rows"), total(rows, "hours").alias("hours"), total(rows, "cost").alias("cost"))), 1)


def structure(df: DataFrame, text: str = "text", finish: str = "finish_reason") -> DataFrame:
    """``df`` with ``sum_hours``, ``sum_cost``, ``hours_match``, ``cost_match`` (null: can't be told),
    ``score`` (the share of nine checks that hold) and ``issues`` (names of those that don't)."""
    t = F.coalesce(F.col(text), F.lit(""))
    declared = lambda p: number(F.nullif(F.regexp_extract(t, p, 1), F.lit("")))
    rows = df.withColumns({"__sums": F.when(t.rlike(HEADER), table_sums(t)), "__hours": declared(TOTAL_HOURS), "__cost": declared(TOTAL_COST)})
    some = F.col("__sums.rows") > 0
    rows = rows.withColumns({"sum_hours": F.when(some, F.col("__sums.hours")), "sum_cost": F.when(some, F.col("__sums.cost"))})
    rows = rows.withColumns({
        "hours_match": F.abs(F.col("sum_hours") - F.col("__hours")) <= HOURS_APART,
        "cost_match": F.when(F.col("__cost") > 0, F.abs(F.col("sum_cost") - F.col("__cost")) / F.col("__cost") <= COST_APART),
    })
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = {"title": t.rlike(TITLE), "table": t.rlike(HEADER), "total_hours": t.rlike(TOTAL_HOURS), "total_cost": t.rlike(TOTAL_COST), "team": t.rlike(TEAM), "duration": t.rlike(DURATION), "hours_match": yes(F.col("hours_match")), "cost_match": yes(F.col("cost_match")), "finished": yes(F.col(finish).isin(*FINISHED))}
    score = F.round(sum((c.cast("int") for c in checks.values()), F.lit(0)) / float(len(checks)), 3)
    # what can't be told lowers the score but is no issue
    bad = {k: ~c if k not in ("hours_match", "cost_match") else yes(~F.col(k)) for k, c in checks.items()}
    return rows.withColumns({"score": score, "issues": F.array_compact(F.array(*[F.when(b, k) for k, b in bad.items()]))}).drop("__sums", "__hours", "__cost")


def recall_by_turn(turns: DataFrame, scenarios: list[str], ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """For the turns of the ladder: mean recall of each scenario (a column each), mean recall of the
    name, and how many superseded facts are still present."""
    rows = turns.where(F.col("turn").isin(*ladder))
    means = [F.round(F.avg(F.when(F.col("scenario") == s, F.col("recall"))), 3).alias(s) for s in scenarios]
    return rows.groupBy("turn").agg(*means, F.round(F.avg("name_recall"), 3).alias("name_recall"), F.sum("stale_present").alias("stale_present"), F.sum("stale_total").alias("stale_total"))


def attachment_table(turns: DataFrame, positions: tuple[str, ...] = ("head", "middle", "tail")) -> DataFrame:
    """For each attachment size: rows, how many were accepted, latency percentiles, mean tokens and
    cost, and mean recall of the markers, read from ``head=1;middle=0;...``."""
    detail = F.str_to_map(F.col("detail"), F.lit(";"), F.lit("="))
    rows = turns.withColumns({p: F.try_element_at(detail, F.lit(p)).try_cast("double") for p in positions})
    sums = rows.groupBy("size_kb").agg(F.count("*").alias("n"), F.count_if(F.coalesce("rejected", F.lit(0)) == 0).alias("accepted"), F.round(F.avg(F.coalesce("tokens_in", F.lit(0.0))), 3).alias("tokens_in"), F.round(F.avg(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"), *[F.round(F.avg(p), 2).alias(p) for p in positions])
    return sums.join(percentiles(rows, ["size_kb"], "latency_ms", (50, 95)), "size_kb", "left")


def key_facts(turns: DataFrame, first: int, last: int, floor: float = 0.6) -> DataFrame:
    """One row: means at the first and last turn with their ratio, the longest summary and how often
    there is one, the most anchors, and the first turn at which the name's recall is under ``floor``."""
    at = lambda n, c: F.avg(F.when(F.col("turn") == n, F.col(c)))
    figures = [x for c in ("latency_ms", "cost_usd", "tokens_in") for x in (F.round(at(first, c), 6).alias(f"{c}_first"), F.round(at(last, c), 6).alias(f"{c}_last"), F.round(F.try_divide(at(last, c), at(first, c)), 4).alias(f"{c}_ratio"))]
    whole = turns.agg(*figures, F.max(F.coalesce("summary_chars", F.lit(0))).alias("summary_most"), F.count_if(F.col("summary_chars") > 0).alias("summary_some"), F.count("*").alias("turns"), F.max(F.coalesce("anchors", F.lit(0))).alias("anchors_most"))
    low = turns.groupBy("turn").agg(F.avg("name_recall").alias("m")).where(F.col("m") < floor).agg(F.min("turn").alias("name_lost_at"))
    # both sides are one row
    return whole.crossJoin(low)


def hit_summary(turns: DataFrame, by: list[str]) -> DataFrame:
    """Groups with their number, share of exact and of semantic cache hits, and mean recall."""
    share = lambda kind: F.round(F.avg((F.col("hit_kind") == kind).cast("double")), 6)
    return turns.groupBy(*by).agg(F.count("*").alias("n"), share("exact").alias("exact_rate"), share("semantic").alias("semantic_rate"), F.round(F.avg("recall"), 6).alias("recall"))


def recalled(haystack: Column, needles: Column) -> Column:
    """Whether a text holds one of the needles, in any case."""
    low = F.lower(haystack)
    return F.coalesce(F.exists(needles, lambda n: F.contains(low, F.lower(n))), F.lit(False))


def memory_scores(facts: DataFrame, by: str) -> DataFrame:
    """For each probe (``by``): the mean over facts that should persist, how many of them are recalled,
    how many superseded ones are still present, and all as ``key=1;key=0``, from (key, expectation,
    recalled)."""
    hit = F.col("recalled").cast("int")
    persist, stale = F.col("expectation") == "persist", F.col("expectation") == "superseded"
    parts = F.array_sort(F.collect_list(F.struct("key", F.concat_ws("=", "key", hit.cast("string")).alias("one"))))
    return facts.groupBy(by).agg(F.round(F.avg(F.when(persist, hit)), 4).alias("memory"), F.count_if(persist).alias("persist_total"), F.count_if(persist & F.col("recalled")).alias("persist_recalled"), F.count_if(stale).alias("stale_total"), F.count_if(stale & F.col("recalled")).alias("stale_present"), F.array_join(F.transform(parts, lambda p: p["one"]), ";").alias("detail"))


def live_facts(facts: DataFrame, turns: DataFrame, by: str) -> DataFrame:
    """(by, turn, key): the facts that were introduced by a turn and not superseded before it.

    Both sides are dealt to all shuffle partitions: put together by their packed sizes, sorted keys pack so well that a
    task would sort many times what it was meant to."""
    n = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = facts.select(F.col(by).alias("__by"), "key", "introduced_at", "superseded_at").repartition(n, "__by")
    met = turns.repartition(n, by).join(f, (F.col(by) == F.col("__by")) & (F.col("introduced_at") <= F.col("turn")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("turn"))))
    return met.select(by, "turn", "key")


def sweep(scenarios: list[str], sizes: list[int], repeats: int) -> Column:
    """All runs of a sweep as an array; its size is that of the parameters."""
    runs = [F.struct(F.lit(s).alias("scenario"), F.lit(k).alias("size_kb"), F.lit(r).alias("repeat")) for s in scenarios for k in sizes for r in range(repeats)]
    return F.array(*runs)


def as_row(results: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Metric rows (name, score, passed) as ``<name>_score`` and ``<name>_passed``, a row for each ``by``."""
    pick = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{c}")
    return results.groupBy(by).agg(*[pick(n, c) for n in names for c in ("score", "passed")])


def answer_text(summary: Column, phases: Column) -> Column:
    """Everything an answer says: its summary and the names and summaries of its phases, empty ones left out."""
    parts = F.concat(F.array(summary), F.flatten(F.transform(phases, lambda p: F.array(p["name"], p["summary"]))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")
