"""Queries over budget records: orders and customers with planted spellings and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.firsts import first_values
from ..functions.hashing import hmac_sha256
from ..functions.records import hours, money, parse_amount, parse_date
from ..functions.text import client_key, estimated_tokens, normalise_currency, unmask_null
from ..operators import privacy, validation
from ..operators.records import clean_records, divergence, keep_latest
from ..streaming.events import shared_folder
from .base import query, table

NOW = "2001-01-01"

RAW = """
SELECT k AS record,
  CASE WHEN k % 101 = 0 THEN 'BDG_' || k ELSE 'BUDGET-' || strftime(d, '%Y') || '-' || lpad((k % 4000)::VARCHAR, 4, '0') END AS budget_id,
  CASE WHEN k % 29 = 0 THEN 'N/A' WHEN k % 31 = 0 THEN '  tbd ' ELSE c_name || CASE k % 3 WHEN 0 THEN ' S.L.' WHEN 1 THEN ', Inc.' ELSE '' END END AS client_name,
  CASE WHEN k % 43 = 0 THEN 'x1' ELSE 'cli-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS client_code,
  CASE WHEN k % 37 = 0 THEN '-' || whole || '.' || cents WHEN k % 41 = 0 THEN 'tbd'
    WHEN k % 4 = 0 THEN whole || '.' || cents WHEN k % 4 = 1 THEN replace(grouped, ',', '.') || ',' || cents WHEN k % 4 = 2 THEN grouped || '.' || cents ELSE whole || '.' || cents || ' €' END AS total_amount,
  CASE WHEN k % 97 = 0 THEN 'xyz' WHEN k % 5 = 0 THEN 'EUR' WHEN k % 5 = 1 THEN ' euros' WHEN k % 5 = 2 THEN '€' WHEN k % 5 = 3 THEN 'usd' ELSE '£' END AS currency,
  ((k % 500)::DOUBLE + CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS hours_estimated,
  CASE WHEN k % 89 = 0 THEN 'soon' WHEN k % 4 = 0 THEN strftime(d, '%Y-%m-%d') WHEN k % 4 = 1 THEN strftime(d, '%d/%m/%Y') WHEN k % 4 = 2 THEN strftime(d, '%b %-d %Y') ELSE strftime(d, '%-d-%-m-%Y') END AS signed_at,
  CASE o_orderstatus WHEN 'O' THEN ' Draft' WHEN 'F' THEN 'SIGNED' ELSE 'rejected' END AS status
FROM (SELECT *, o_orderkey AS k, o_orderdate AS d, (round(o_totalprice * 100)::BIGINT // 100)::VARCHAR AS whole, format('{:,}', round(o_totalprice * 100)::BIGINT // 100) AS grouped, lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS cents FROM orders JOIN customer ON o_custkey = c_custkey)
"""

CLEAN = f"""
raw AS ({RAW}), bare AS (SELECT *, regexp_replace(total_amount, '[\\s€$]', '', 'g') AS b FROM raw), clean AS (
SELECT record, budget_id,
  CASE WHEN lower(trim(client_name)) NOT IN ('n/a', 'tbd', '') THEN trim(client_name) END AS client_name,
  upper(client_code) AS client_code,
  TRY_CAST(CASE WHEN regexp_matches(b, '^-?\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?$') THEN replace(replace(b, '.', ''), ',', '.') WHEN regexp_matches(b, '^-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN replace(b, ',', '') ELSE replace(b, ',', '.') END AS DOUBLE) AS total_amount,
  CASE lower(trim(currency)) WHEN 'eur' THEN 'EUR' WHEN 'euros' THEN 'EUR' WHEN '€' THEN 'EUR' WHEN 'usd' THEN 'USD' WHEN '£' THEN 'GBP' ELSE upper(trim(currency)) END AS currency,
  hours_estimated,
  coalesce(try_strptime(signed_at, '%Y-%m-%d'), try_strptime(signed_at, '%d/%m/%Y'), try_strptime(signed_at, '%b %d %Y'), try_strptime(signed_at, '%d-%m-%Y')) AS signed_at,
  lower(trim(status)) AS status
FROM bare)
"""

VALIDATED = f"""
{CLEAN}, checked AS (
SELECT *, list_filter([
  CASE WHEN budget_id IS NULL THEN 'budget_id:not_null' END,
  CASE WHEN NOT regexp_matches(budget_id, '^BUDGET-\\d{{4}}-\\d{{4}}$') THEN 'budget_id:str_matches' END,
  CASE WHEN client_name IS NULL THEN 'client_name:not_null' END,
  CASE WHEN length(client_name) NOT BETWEEN 2 AND 200 THEN 'client_name:str_length' END,
  CASE WHEN NOT regexp_matches(client_code, '^CLI-\\d{{4}}$') THEN 'client_code:str_matches' END,
  CASE WHEN total_amount IS NULL THEN 'total_amount:not_null' END,
  CASE WHEN total_amount NOT BETWEEN 0 AND 10000000 THEN 'total_amount:in_range' END,
  CASE WHEN coalesce(currency NOT IN ('EUR', 'USD', 'GBP'), true) THEN 'currency:isin' END,
  CASE WHEN NOT (hours_estimated > 0 AND hours_estimated <= 100000) THEN 'hours_estimated:in_range' END,
  CASE WHEN signed_at IS NULL THEN 'signed_at:not_null' END,
  CASE WHEN signed_at > TIMESTAMP '{NOW}' THEN 'signed_at:signature_not_in_the_future' END,
  CASE WHEN coalesce(status NOT IN ('draft', 'signed', 'rejected'), true) THEN 'status:isin' END,
  CASE WHEN status = 'signed' AND total_amount <= 0 THEN 'row:signed_needs_amount' END], lambda x: x IS NOT NULL) AS failures
FROM clean), validated AS (
SELECT *, CASE WHEN len(failures) = 0 THEN 'valid' WHEN list_has_any(failures, ['budget_id:str_matches', 'client_code:str_matches', 'total_amount:in_range', 'hours_estimated:in_range', 'signed_at:signature_not_in_the_future']) THEN 'discarded' ELSE 'quarantined' END AS outcome
FROM checked)
"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget records as text, with spellings and faults that follow from the order's key."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    n = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, cents = F.floor(n / 100).cast("long"), F.lpad((n % 100).cast("string"), 2, "0")
    grouped, plain = F.format_number(whole, 0), F.concat(whole.cast("string"), F.lit("."), cents)
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    suffix = F.when(k % 3 == 0, " S.L.").when(k % 3 == 1, ", Inc.").otherwise("")
    date = F.when(k % 89 == 0, "soon").when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(d, "MMM d yyyy")).otherwise(F.date_format(d, "d-M-yyyy"))
    amount = F.when(k % 37 == 0, F.concat(F.lit("-"), plain)).when(k % 41 == 0, "tbd").when(k % 4 == 0, plain).when(k % 4 == 1, F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), cents)).when(k % 4 == 2, F.concat(grouped, F.lit("."), cents)).otherwise(F.concat(plain, F.lit(" €")))
    return rows.select(
        k.alias("record"),
        F.when(k % 101 == 0, F.concat(F.lit("BDG_"), k.cast("string"))).otherwise(F.concat(F.lit("BUDGET-"), F.date_format(d, "yyyy"), F.lit("-"), F.lpad((k % 4000).cast("string"), 4, "0"))).alias("budget_id"),
        F.when(k % 29 == 0, "N/A").when(k % 31 == 0, "  tbd ").otherwise(F.concat("c_name", suffix)).alias("client_name"),
        F.when(k % 43 == 0, "x1").otherwise(F.concat(F.lit("cli-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))).alias("client_code"),
        amount.alias("total_amount"),
        F.when(k % 97 == 0, "xyz").when(k % 5 == 0, "EUR").when(k % 5 == 1, " euros").when(k % 5 == 2, "€").when(k % 5 == 3, "usd").otherwise("£").alias("currency"),
        ((k % 500).cast("double") + F.when(k % 2 == 0, 0.5).otherwise(0.0)).alias("hours_estimated"),
        date.alias("signed_at"),
        F.when(F.col("o_orderstatus") == "O", " Draft").when(F.col("o_orderstatus") == "F", "SIGNED").otherwise("rejected").alias("status"),
    )


def validated_records(spark: SparkSession, sf_dir: str, mode: str = "strict") -> DataFrame:
    clean = clean_records(raw_records(spark, sf_dir))
    return validation.validate(clean, validation.budget_checks(F.lit(NOW).cast("timestamp")), mode)


@query(f"WITH {CLEAN} SELECT record, total_amount, currency FROM clean")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).select("record", parse_amount(F.col("total_amount")).alias("total_amount"), normalise_currency(F.col("currency")).alias("currency"))


@query(f"WITH {CLEAN} SELECT record, strftime(signed_at, '%Y-%m-%d') AS signed_on FROM clean")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).select("record", F.date_format(parse_date(F.col("signed_at")), "yyyy-MM-dd").alias("signed_on"))


@query(f"WITH {CLEAN} SELECT client_name, count(*) AS n FROM clean GROUP BY client_name")
def unmask_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).groupBy(unmask_null(F.col("client_name")).alias("client_name")).agg(F.count("*").alias("n"))


@query(r"""
SELECT s_suppkey, nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), '\b(?:s ?l|s ?a|inc|ltd|llc|plc|corp|corporation|company|gmbh|srl|bv|ag)\b', '', 'g'), '\s+', ' ', 'g')), '') AS client_key
FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 5 WHEN 0 THEN ' S.L.' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' GmbH' WHEN 3 THEN '  Corp. ' ELSE '' END AS name FROM supplier)
""")
def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    name = F.concat("s_name", F.when(k == 0, " S.L.").when(k == 1, ", Inc.").when(k == 2, " GmbH").when(k == 3, "  Corp. ").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", client_key(name).alias("client_key"))


@query(f"WITH {VALIDATED} SELECT record, budget_id, outcome, array_to_string(list_sort(list_distinct(failures)), '; ') AS reasons FROM validated")
def validate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated_records(spark, sf_dir).select("record", "budget_id", "outcome", validation.reasons(F.col("failures")).alias("reasons"))


@query(f"WITH {VALIDATED} SELECT unnest(failures) AS \"check\", count(*) AS n FROM validated GROUP BY 1")
def validate_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.breakdown(validated_records(spark, sf_dir))


@query(f"WITH {VALIDATED} SELECT count(*) AS total, count(*) FILTER (outcome = 'valid') AS valid, count(*) FILTER (outcome = 'quarantined') AS quarantined, count(*) FILTER (outcome = 'discarded') AS discarded, round(count(*) FILTER (outcome = 'valid')::DOUBLE / count(*), 6) AS pass_rate FROM validated")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.report(validated_records(spark, sf_dir))


@query(f"WITH {VALIDATED} SELECT CASE WHEN outcome = 'valid' THEN outcome ELSE 'quarantined' END AS outcome, count(*) AS n FROM validated GROUP BY 1")
def validate_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated_records(spark, sf_dir, "permissive").groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {CLEAN} SELECT budget_id, record, round(total_amount, 2) AS total_amount, strftime(signed_at, '%Y-%m-%d') AS signed_on FROM (SELECT *, row_number() OVER (PARTITION BY budget_id ORDER BY signed_at DESC NULLS LAST, record DESC) AS r FROM clean) WHERE r = 1")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = keep_latest(clean_records(raw_records(spark, sf_dir)))
    return latest.select("budget_id", "record", F.round("total_amount", 2).alias("total_amount"), F.date_format("signed_at", "yyyy-MM-dd").alias("signed_on"))


@query(f"WITH {CLEAN} SELECT budget_id, count(*) AS versions, count(DISTINCT (coalesce(total_amount::VARCHAR, '<null>') || '|' || currency || '|' || status)) AS distinct_versions, count(*) - count(DISTINCT (coalesce(total_amount::VARCHAR, '<null>') || '|' || currency || '|' || status)) AS exact_duplicates FROM clean GROUP BY budget_id HAVING count(*) > 1")
def divergent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(clean_records(raw_records(spark, sf_dir)))


_KEY = "change-me-in-prod"
_IPAD, _OPAD = (bytes(b ^ p for b in _KEY.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
_HMAC = f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(v))))"


@query(f"SELECT 'CLIENT' AS entity_type, {_HMAC} AS original_hash, count(*) AS occurrences, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen_at FROM (SELECT c_mktsegment || ':' || (c_custkey % 97)::VARCHAR AS v, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY v")
def hmac_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    values = rows.select(F.lit("CLIENT").alias("entity_type"), F.concat("c_mktsegment", F.lit(":"), (F.col("c_custkey") % 97).cast("string")).alias("value"), F.lit("orders").alias("source_name"), F.col("o_orderdate").alias("seen_at"))
    return privacy.mapping(values, _KEY).select("entity_type", "original_hash", "occurrences", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen_at"))


@query(f"SELECT {_HMAC} AS original_hash, count(*) AS occurrences FROM (SELECT c_mktsegment AS v FROM customer) WHERE v <> 'BUILDING' GROUP BY v")
def forget_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select(F.lit("SEGMENT").alias("entity_type"), F.col("c_mktsegment").alias("value"), F.lit("customer").alias("source_name"), F.col("c_custkey").alias("seen_at"))
    kept, _ = privacy.forget(privacy.mapping(values, _KEY), _KEY, spark.createDataFrame([("BUILDING",)], "value string"))
    return kept.select("original_hash", "occurrences")


# Sightings of customers and suppliers; two nations' customers are forgotten, one comes back later.
@query(f"""
WITH c AS (SELECT 'CLIENT' AS entity_type, c_mktsegment || ':' || c_nationkey AS v, c_nationkey AS nation, 'customer' AS source_name, c_custkey % 30 AS day FROM customer),
s AS (SELECT 'SUPPLIER' AS entity_type, 'BUILDING:' || s_nationkey AS v, s_nationkey AS nation, 'supplier' AS source_name, s_suppkey % 20 AS day FROM supplier),
again AS (SELECT entity_type, v, nation, 'again' AS source_name, 40 + day % 5 AS day FROM c WHERE nation % 2 = 1),
known AS (SELECT entity_type, v, count(*) AS n, min(day) AS day, 'customer' AS source_name FROM c GROUP BY entity_type, v UNION ALL SELECT entity_type, v, count(*), min(day), 'supplier' FROM s GROUP BY entity_type, v),
kept AS (SELECT * FROM known WHERE split_part(v, ':', 2) NOT IN ('3', '4')),
late AS (SELECT entity_type, v, count(*) AS n, min(day) AS day, 'again' AS source_name FROM again GROUP BY entity_type, v)
SELECT entity_type, {_HMAC} AS original_hash, coalesce(k.n, 0) + coalesce(l.n, 0) AS occurrences, coalesce(k.day, l.day)::BIGINT AS first_day, coalesce(k.source_name, l.source_name) AS source_name
FROM kept k FULL JOIN late l USING (entity_type, v)
""")
def stored_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = privacy.MappingStore(spark, shared_folder(spark), _KEY, buckets=16)
    sightings = lambda rows, kind, value, name, day: rows.select(F.lit(kind).alias("entity_type"), value.alias("value"), F.lit(name).alias("source_name"), F.timestamp_seconds(day * 86_400).alias("seen_at"))
    clients, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    client, key = F.concat_ws(":", "c_mktsegment", "c_nationkey"), F.col("c_custkey")
    store.record(sightings(clients, "CLIENT", client, "customer", key % 30))
    store.record(sightings(suppliers, "SUPPLIER", F.concat_ws(":", F.lit("BUILDING"), "s_nationkey"), "supplier", F.col("s_suppkey") % 20))
    store.forget(clients.select("c_mktsegment").distinct().select(F.explode(F.transform(F.array(F.lit("3"), F.lit("4")), lambda n: F.concat_ws(":", "c_mktsegment", n))).alias("value")))
    store.record(sightings(clients.where("c_nationkey % 2 = 1"), "CLIENT", client, "again", 40 + key % 30 % 5))
    return store.table.read().select("entity_type", "original_hash", "occurrences", F.floor(F.unix_seconds("first_seen_at") / 86_400).alias("first_day"), "source_name")


@query("""
SELECT o_orderkey, '# Budget ' || o_orderkey || chr(10) || 'Status: ' || o_orderstatus || chr(10) || 'Total: ' || format('{:,.2f}', o_totalprice) || ' EUR' || chr(10) || '| part | hours | cost |' || chr(10) || string_agg('| ' || l_partkey || ' | ' || l_quantity::BIGINT || ' | ' || format('{:,.2f}', l_extendedprice) || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS markdown
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice
""")
def render_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), hours(F.col("l_quantity")), F.lit(" | "), money(F.col("l_extendedprice")), F.lit(" |")).alias("line")))).alias("rows"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.concat(F.lit("# Budget "), F.col("o_orderkey").cast("string"), F.lit("\nStatus: "), "o_orderstatus", F.lit("\nTotal: "), money(F.col("o_totalprice")), F.lit(" EUR\n| part | hours | cost |\n"))
    return both.select("o_orderkey", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS phases, round(coalesce(sum(l_extendedprice), 0), 2) AS phase_cost, abs(coalesce(sum(l_extendedprice), 0) - o_totalprice) <= 0.02 * o_totalprice AS adds_up
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice
""")
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("phases"), F.sum("l_extendedprice").alias("cost"))
    both = table(spark, sf_dir, "orders").join(phases, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cost = F.coalesce("cost", F.lit(0.0))
    return both.select("o_orderkey", F.coalesce("phases", F.lit(0)).alias("phases"), F.round(cost, 2).alias("phase_cost"), (F.abs(cost - F.col("o_totalprice")) <= 0.02 * F.col("o_totalprice")).alias("adds_up"))


_CHUNKS = """
SELECT o_orderkey || '::' || l_linenumber AS chunk_id, text, ceil(length(text) / 4.0)::BIGINT AS tokens FROM (
  SELECT o_orderkey, l_linenumber, 'Budget ' || o_orderkey || ' for ' || c_name || chr(10) || 'Component: ' || p_name || chr(10) || 'Stack: ' || p_brand || ', ' || p_type || chr(10) || 'Hours: ' || l_quantity::BIGINT AS text
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each component of a budget, with its budget as context."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    text = F.concat(F.lit("Budget "), F.col("o_orderkey").cast("string"), F.lit(" for "), "c_name", F.lit("\nComponent: "), "p_name", F.lit("\nStack: "), F.array_join(F.array("p_brand", "p_type"), ", "), F.lit("\nHours: "), hours(F.col("l_quantity")))
    return rows.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("::"), F.col("l_linenumber").cast("string")).alias("chunk_id"), text.alias("text")).withColumn("tokens", estimated_tokens(F.col("text")))


@query(_CHUNKS)
def component_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query(f"SELECT count(DISTINCT split_part(chunk_id, '::', 1)) AS budgets, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, max(tokens) AS most, round(sum(tokens)::DOUBLE * 0.02 / 1000000, 8) AS cost_usd, count(*) FILTER (tokens > 28) AS oversized FROM ({_CHUNKS})")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).agg(F.countDistinct(F.substring_index("chunk_id", "::", 1)).alias("budgets"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), F.round(F.sum("tokens") * 0.02 / 1e6, 8).alias("cost_usd"), F.count_if(F.col("tokens") > 28).alias("oversized"))


@query(f"""
SELECT brand, list_aggregate(list_slice(list_sort(list(chunk_id)), 1, 10), 'string_agg', ',') AS first_ids, count(*) AS oversized FROM (
  SELECT chunk_id, regexp_extract(text, 'Stack: ([^,]*)', 1) AS brand FROM ({_CHUNKS}) WHERE tokens > 22) GROUP BY brand
""")
def oversized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where(F.col("tokens") > 22).withColumn("brand", F.regexp_extract("text", "Stack: ([^,]*)", 1))
    counts = rows.groupBy("brand").agg(F.count("*").alias("oversized"))
    return first_values(rows, ["brand"], F.col("chunk_id"), 10).join(counts, "brand").select("brand", F.array_join("firsts", ",").alias("first_ids"), "oversized")


@query("SELECT '| ' || 'n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def nation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.documents import markdown_table

    return markdown_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], "n_nationkey")


@query(f"SELECT {_HMAC.replace('encode(v)', 'encode(c_name)')} AS key, c_custkey FROM customer")
def customer_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(hmac_sha256(_KEY, F.col("c_name")).alias("key"), "c_custkey")
