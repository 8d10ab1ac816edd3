"""Queries over requests and small reports: conversations as requests, events and parts as figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, cache_text
from ..operators import analytics, attachments, embedding, metrics, privacy, report, requests, validation
from .base import query, table
from .records import _HMAC, _KEY


@query("""
SELECT conv_id, turn, role, array_to_string(list_filter([CASE WHEN n < 20 THEN 'description:too_short' END, CASE WHEN n > 80000 THEN 'description:too_long' END, CASE WHEN turn NOT BETWEEN 1 AND 50 THEN 'top_k:in_range' END], lambda x: x IS NOT NULL), ',') AS failures
FROM (SELECT conv_id, turn, role, length(trim(text)) AS n FROM conversations)
""")
def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("description"), F.col("turn").alias("top_k"))
    return validation.validate(rows, requests.request_checks(["description", "top_k"])).select("conv_id", "turn", "role", F.array_join("failures", ",").alias("failures"))


@query("""SELECT 'estimation:' || sha256('{"kind":"' || event_type || '","text":"user ' || user_id || '"}') AS key, count(*) AS n FROM events GROUP BY key""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  User\t "), F.col("user_id").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "events").groupBy(requests.request_key("estimation:", text, kind=F.col("event_type")).alias("key")).agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_type || '  ' || p_name), '\s+', ' ', 'g')) AS text, p_brand AS name FROM part")
def cache_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a/b/"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", cache_text(F.concat(F.lit(" "), "p_type", F.lit("\t\n"), "p_name", F.lit("\n"))).alias("text"), basename(path).alias("name"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN toxic >= 1 THEN 'abuse' END, CASE WHEN quality >= 1 THEN 'praise' END], lambda x: x IS NOT NULL), ',') AS flagged FROM labels")
def moderation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.create_map(F.lit("praise"), F.col("quality").cast("double"), F.lit("abuse"), F.col("toxic").cast("double"))
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(requests.flagged_categories(scores, 1.0), ",").alias("flagged"))


@query("""
SELECT conv_id, turn, role, round((h + m + t) / 3.0::DOUBLE, 4) AS recall, 'head=' || h || ';middle=' || m || ';tail=' || t AS detail
FROM (SELECT conv_id, turn, role, (contains(lower(text), 'le ') OR contains(lower(text), 'the '))::INT AS h, contains(lower(text), 'und')::INT AS m, contains(lower(text), 'ción')::INT AS t FROM conversations)
""")
def marker_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.marker_recall(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role"], "text", {"head": ["le ", "The "], "middle": ["UND"], "tail": ["ción"]})


@query("SELECT o_orderkey, (DATE '2002-01-01' - o_orderdate::DATE)::INT AS days, CASE WHEN (DATE '2002-01-01' - o_orderdate::DATE) / 365.0::DOUBLE <= 1.25 THEN 'ok' WHEN (DATE '2002-01-01' - o_orderdate::DATE) / 365.0::DOUBLE <= 2.5 THEN 'late' ELSE 'abandoned' END AS verdict FROM orders")
def order_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.catalog import staleness

    days = requests.lag_days(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.alias("days"), staleness(days, F.lit("yearly")).alias("verdict"))


@query("SELECT event_id, coalesce(TRY_CAST(v AS DOUBLE) <= 20, false) AS within FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE value::VARCHAR END AS v FROM events)")
def sla_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    value = F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, F.lit(None).cast("string")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", analytics.within_budget(value, 20).alias("within"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_retailprice / 1500 > 0.70 THEN 'context' END, CASE WHEN p_size / 500.0::DOUBLE > 0.05 THEN 'cost' END, CASE WHEN p_size * 100 > 3000 THEN 'latency' END], lambda x: x IS NOT NULL), ',') AS broken FROM part")
def broken_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(analytics.ceilings(F.col("p_retailprice"), F.lit(1500), size / 500.0, size * 100), ",").alias("broken"))


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS url FROM pages")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", attachments.data_url(F.col("html").cast("binary"), F.lit("text/html")).alias("url"))


@query("SELECT n_regionkey, string_agg('Example ' || k || ':' || chr(10) || n_name, chr(10) || chr(10) ORDER BY k) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY n_regionkey")
def example_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numbered(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query(f"SELECT {_HMAC} AS original_hash, count(*) AS occurrences, min(day)::VARCHAR AS first_seen_at FROM (SELECT c_mktsegment AS v, c_custkey % 30 AS day FROM customer UNION ALL SELECT c_mktsegment, c_custkey % 20 FROM customer WHERE c_custkey % 2 = 0) GROUP BY v")
def mapping_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lambda rows, days: privacy.mapping(rows.select(F.lit("SEGMENT").alias("entity_type"), F.col("c_mktsegment").alias("value"), F.lit("customer").alias("source_name"), (F.col("c_custkey") % days).alias("seen_at")), _KEY)
    customers = table(spark, sf_dir, "customer")
    both = privacy.merge_mapping(values(customers, 30), values(customers.where("c_custkey % 2 = 0"), 20))
    return both.select("original_hash", "occurrences", F.col("first_seen_at").cast("string").alias("first_seen_at"))


@query("SELECT p_partkey, left(sha256('Estimate the work.' || chr(10) || 'Request: ' || p_name), 12) AS prompt_hash FROM part")
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    text = report.prompt(F.col("p_name"), none, none, none, F.array().cast("array<string>"), none)
    return table(spark, sf_dir, "part").select("p_partkey", report.prompt_hash(text).alias("prompt_hash"))


def _length_metric(o: dict) -> tuple[float, bool, str]:
    if o["value"] > 90:
        raise ValueError(f"event {o['event_id']} is out of range")
    return len(o["event_type"]) / 10, len(o["event_type"]) > 4, o["event_type"]


@query("""
WITH e AS (SELECT event_id, event_type, value, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE value::VARCHAR END AS v FROM events), n AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x FROM e)
SELECT event_id, 0 AS place, 'latency' AS name, coalesce((x <= 20)::INT, 0)::DOUBLE AS score, coalesce(x <= 20, false) AS passed,
  CASE WHEN v IS NULL THEN 'no value' WHEN x IS NULL THEN 'not a number: ' || v WHEN x <= 20 THEN printf('%.2f ms, %.2f ms left', x, 20 - x) ELSE printf('%.2f ms, %.2f ms over', x, x - 20) END AS details FROM n
UNION ALL SELECT event_id, 1, 'length', CASE WHEN value > 90 THEN 0 ELSE length(event_type) / 10 END, value <= 90 AND length(event_type) > 4, CASE WHEN value > 90 THEN 'metric raised ValueError: event ' || event_id || ' is out of range' ELSE event_type END FROM e
UNION ALL SELECT event_id, 2, 'spent', (value <= 50)::INT::DOUBLE, value <= 50, CASE WHEN value <= 50 THEN printf('%.2f USD, %.2f USD left', value, 50 - value) ELSE printf('%.2f USD, %.2f USD over', value, value - 50) END FROM e
""")
def metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    text = F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, F.lit(None).cast("string")).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", text.alias("v"))
    return metrics.run_metrics(rows, ["event_id"], [metrics.Metric("latency", metrics.within(F.col("v"), 20, "ms")), metrics.Metric("length", _length_metric), metrics.Metric("spent", metrics.within(F.col("value"), 50, "USD"))])


class _Letters:
    """A vectoriser for tests: a text's length, spaces and digits. It answers from the last text to the first,
    and tells every request to slow down once."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        if texts[0] not in self.asked:
            self.asked.add(texts[0])
            raise embedding.SlowDown
        return [(k, [float(len(t)), float(t.count(" ")), float(sum(c in "0123456789" for c in t))]) for k, t in reversed(list(enumerate(texts)))]


@query("SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS digits FROM documents")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embedding.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), _Letters(), 3, waits=(0.0,))
    return got.select("doc_id", *[F.get("embedding", F.lit(k)).alias(n) for k, n in enumerate(("chars", "spaces", "digits"))])
