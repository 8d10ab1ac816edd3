"""Queries over files: an ingest run, a census, record files; and over budgets that are to be embedded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, ingest, report, validation
from ..sources import catalog, files, folders, pdf
from ..sources.storage import Scope
from ..streaming.events import shared_folder
from .base import query, table
from .made_pdf import make_pdf
from .documents import _REASON, _SPACE, _TIDY
from .records import NOW, VALIDATED, raw_records

_KEY = "change-me-in-prod"
ENTRY = {"format": "txt", "pipeline": "text", "decision": "include", "contains_pii": False, "completeness": 4, "consistency": 4, "actuality": 4, "reliability": 4, "refresh": "monthly", "lag_days": 10}
SOURCES = [
    ENTRY | {"name": "budgets", "location": "lake://budgets", "format": "json", "pipeline": "tabular"},
    ENTRY | {"name": "transcripts", "location": "lake://transcripts"},
    ENTRY | {"name": "contracts", "location": "lake://contracts", "format": "pdf", "contains_pii": True},
    ENTRY | {"name": "scans", "location": "lake://scans", "format": "csv"},
    ENTRY | {"name": "nothing_yet", "location": "lake://nothing_yet"},
    ENTRY | {"name": "legacy", "location": "lake://legacy", "decision": "exclude", "decision_reason": "out of date"},
]


def lay_out(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ("budgets", "transcripts", "contracts"), root: str | None = None, part: Column | None = None) -> str:
    """Files of all formats below a shared folder, made of the tables: budgets as JSON arrays, and texts. Some of
    the folders if ``only`` names them, some of their buckets if ``part`` is a condition on ``bucket``."""
    root = root or shared_folder(spark)
    some = lambda df: df if part is None else df.where(part)
    write = lambda df, name: df.repartition("bucket").write.mode("append").partitionBy("bucket").text(f"{root}/{name}")
    if "budgets" in only:
        names = ["budget_id", "client_name", "client_code", "total_amount", "currency", "hours_estimated", "signed_at", "status"]
        raw = some(raw_records(spark, sf_dir).withColumn("bucket", F.floor(F.col("record") / 1000)))
        write(raw.groupBy("bucket").agg(F.to_json(F.collect_list(F.struct(*names))).alias("value")), "budgets")
    if "transcripts" in only:
        line = F.concat(F.lit("[00:00:01] "), "role", F.lit(": "), F.regexp_replace("text", r"[\r\n]+", " "))
        turns = some(table(spark, sf_dir, "conversations").withColumn("bucket", F.floor(F.col("conv_id") / 50)))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "role", line.alias("line")))), lambda t: t["line"]), "\n")
        write(turns.groupBy("bucket").agg(text.alias("value")), "transcripts")
    if "contracts" in only:
        docs = some(table(spark, sf_dir, "documents").withColumn("bucket", F.floor(F.col("doc_id") / 200)))
        page = F.concat(F.lit("--- Page "), (F.col("doc_id") % 200 + 1).cast("string"), F.lit(" ---\n"), "text")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", page.alias("page")))), lambda t: t["page"]), "\n")
        write(docs.groupBy("bucket").agg(text.alias("value")), "contracts")
    return root


_LATEST = "latest AS (SELECT c.* FROM clean c JOIN (SELECT record, row_number() OVER (PARTITION BY c.budget_id ORDER BY c.signed_at DESC NULLS LAST, concat_ws('|', r.budget_id, r.client_name, r.client_code, r.total_amount, r.currency, r.hours_estimated::VARCHAR, r.signed_at, r.status) DESC) AS n FROM clean c JOIN raw r USING (record)) USING (record) WHERE n = 1)"
_ROUTED = VALIDATED.replace(", checked AS (", f", {_LATEST}, checked AS (").replace("FROM clean), validated", "FROM latest), validated")


def _kept(text: str, where: str) -> str:
    tidy = _TIDY.replace("(text,", f"({text},")
    bare = rf"regexp_replace(regexp_replace({tidy}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
    return f"(SELECT count(*) FROM (SELECT {bare} AS t FROM {where}) WHERE ({_REASON}) IS NULL)"


_TURN = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"


@query(f"""
WITH {_ROUTED.strip()}
SELECT 'budgets' AS source, 'include' AS decision, (SELECT count(DISTINCT record // 1000) FROM raw) AS files_seen, (SELECT count(*) FROM raw) AS units_parsed, count(*) FILTER (outcome = 'valid') AS records_valid, count(*) FILTER (outcome = 'quarantined') AS records_quarantined, count(*) FILTER (outcome = 'discarded') AS records_discarded,
  count(*) FILTER (outcome = 'valid') AS units_kept, count(*) FILTER (outcome = 'valid') AS documents, 0::BIGINT AS duplicate_ids, NULL AS errors, NULL AS skipped_reason FROM validated
UNION ALL SELECT 'transcripts', 'include', (SELECT count(DISTINCT conv_id // 50) FROM conversations), (SELECT count(*) FROM conversations), 0, 0, 0, {_kept(_TURN, 'conversations')}, {_kept(_TURN, 'conversations')}, 0, NULL, NULL
UNION ALL SELECT 'contracts', 'include', (SELECT count(DISTINCT doc_id // 200) FROM documents), (SELECT count(*) FROM documents), 0, 0, 0, {_kept('text', 'documents')}, {_kept('text', 'documents')}, 0, NULL, NULL
UNION ALL SELECT 'scans', 'include', 0, 0, 0, 0, 0, 0, 0, 0, 'no parser for format ''csv''', NULL
UNION ALL SELECT 'nothing_yet', 'include', 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL
UNION ALL SELECT 'legacy', 'exclude', 0, 0, 0, 0, 0, 0, 0, 0, NULL, 'out of date'
""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = ingest.run(catalog.catalog_of(spark, SOURCES), lay_out(spark, sf_dir), F.lit(NOW).cast("timestamp"), _KEY)
    return found.drop("entities_replaced")


@query("SELECT (conv_id // 50)::VARCHAR AS bucket, count(*) AS n, count(DISTINCT role) AS speakers FROM conversations WHERE length(text) >= 100 GROUP BY 1")
def ingest_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = ingest.run(catalog.catalog_of(spark, SOURCES), lay_out(spark, sf_dir, ("transcripts",)), F.lit(NOW).cast("timestamp"), _KEY, names=["transcripts", "legacy"])
    long = docs.where(F.length("content") >= 100).withColumn("bucket", F.regexp_extract("document", "bucket=([0-9]+)", 1))
    return long.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"))


@query("""
SELECT folder, count(DISTINCT b) AS files, formats FROM (SELECT 'budgets' AS folder, o_orderkey // 1000 AS b, 'txt' AS formats FROM orders UNION ALL SELECT 'transcripts', conv_id // 50, 'txt' FROM conversations UNION ALL SELECT 'contracts', doc_id // 200, 'txt' FROM documents) GROUP BY folder, formats
UNION ALL SELECT NULL, (SELECT count(DISTINCT o_orderkey // 1000) FROM orders) + (SELECT count(DISTINCT conv_id // 50) FROM conversations) + (SELECT count(DISTINCT doc_id // 200) FROM documents), 'txt'
""")
def folder_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.read_files(spark, lay_out(spark, sf_dir), "part-*").drop("content")
    rows = found.withColumn("folder", F.regexp_extract("path", "/(budgets|transcripts|contracts)/", 1))
    return files.census(rows, ["folder"]).select("folder", "files", F.array_join("formats", ",").alias("formats"))


@query("SELECT o_orderkey AS record, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' END AS error FROM orders WHERE o_orderkey % 7 <> 0")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.when(F.col("o_orderkey") % 7 == 0, "failed").alias("error"), F.lit('a "b", c\nd').alias("note"), F.lit(1).alias("left_out"))
    files.write_csv(rows, folder, ["record", "error", "note"])
    _, fine = files.csv_rows(spark, folder, "record long, error string, note string")
    return fine.select("record", "error")


# Budgets with nested components, with faults that follow from the key.
_BUDGETS = """(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 23 = 0 THEN 'B::' || o_orderkey ELSE 'B-' || o_orderkey END AS budget_id, CASE o_orderkey % 4 WHEN 0 THEN 'FinTech' WHEN 1 THEN ' retail' WHEN 2 THEN 'medical' ELSE 'mining' END AS sector, CASE WHEN o_orderkey % 13 = 0 THEN 'spain' ELSE 'ES' END AS country, 1990 + o_orderkey % 50 AS year, o_totalprice AS total FROM orders)"""
_SECTOR = "CASE sector WHEN 'FinTech' THEN 'finance' WHEN ' retail' THEN 'ecommerce' WHEN 'medical' THEN 'healthcare' ELSE 'mining' END"


def nested_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sector = F.when(k % 4 == 0, "FinTech").when(k % 4 == 1, " retail").when(k % 4 == 2, "medical").otherwise("mining")
    part = F.struct(F.concat(F.lit("C-"), F.col("l_linenumber").cast("string")).alias("component_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.col("l_returnflag").alias("description"), F.array("l_linestatus").alias("tech_stack"), (F.col("l_quantity") - 1).alias("estimated_hours"), F.when(F.col("l_suppkey") % 2 == 0, "low").otherwise("high").alias("complexity"), F.array().cast("array<string>").alias("dependencies"))
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("components"))
    both = table(spark, sf_dir, "orders").join(parts, k == F.col("l_orderkey"), "left")
    return both.select(k.alias("k"), F.when(k % 23 == 0, F.concat(F.lit("B::"), k.cast("string"))).otherwise(F.concat(F.lit("B-"), k.cast("string"))).alias("budget_id"), F.struct(F.lit("Acme").alias("name"), sector.alias("sector"), F.when(k % 13 == 0, "spain").otherwise("ES").alias("country")).alias("client"), F.lit("parts").alias("project_summary"), F.lit("steel").alias("main_technology"), (1990 + k % 50).alias("year"), F.col("o_totalprice").alias("total_estimated_hours"), "components")


@query(f"""
SELECT k, array_to_string(list_filter([CASE WHEN k % 23 = 0 THEN 'budget_id' END, CASE WHEN sector = 'mining' THEN 'client.sector' END, CASE WHEN country <> 'ES' THEN 'client.country' END, CASE WHEN year < 2000 THEN 'year' END, CASE WHEN n IS NULL THEN 'components' END, CASE WHEN least_hours <= 0 THEN 'component.estimated_hours' END], lambda x: x IS NOT NULL), ',') AS failures
FROM {_BUDGETS} LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_quantity - 1) AS least_hours FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k
""")
def embed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(nested_budgets(spark, sf_dir), embedding.budget_checks()).select("k", F.array_join("failures", ",").alias("failures"))


@query(f"""
SELECT chunk_id, text, ceil(length(text) / 4.0)::BIGINT AS tokens, client_sector, estimated_hours, true AS complete FROM (
  SELECT budget_id || '::C-' || l_linenumber AS chunk_id, {_SECTOR} AS client_sector, (l_quantity - 1)::BIGINT::VARCHAR AS estimated_hours,
    'Project: parts' || chr(10) || 'Client: Acme (' || {_SECTOR} || ', ' || country || ')' || chr(10) || 'Technology: steel' || chr(10) || 'Component: part ' || l_partkey || chr(10) || l_returnflag || chr(10) || 'Stack: ' || l_linestatus || chr(10) || 'Hours: ' || (l_quantity - 1)::BIGINT || chr(10) || 'Complexity: ' || CASE WHEN l_suppkey % 2 = 0 THEN 'low' ELSE 'high' END AS text
  FROM {_BUDGETS} JOIN lineitem ON l_orderkey = k)
""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embedding.chunks(nested_budgets(spark, sf_dir))
    return got.select("chunk_id", "text", "tokens", F.col("metadata")["client_sector"].alias("client_sector"), F.col("metadata")["estimated_hours"].alias("estimated_hours"), embedding.has_required(F.col("metadata")).alias("complete"))


@query("SELECT c.vec_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ORDER BY 2 DESC, 1 LIMIT 10")
def top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    question = vectors.agg(F.min_by("embedding", "vec_id")).first()[0]
    return embedding.search(vectors, list(question), 10)


_SCORED = "(SELECT source AS name, 1 + count(*) % 5 AS a, 1 + count(quality) % 5 AS b, 1 + coalesce(sum(quality), 0)::BIGINT % 5 AS c, 1 + coalesce(sum(toxic), 0)::BIGINT % 5 AS d FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"
_BAR = lambda c: f"repeat('●', {c}) || repeat('○', 5 - {c})"


@query(f"SELECT name, '| `' || name || '` | ' || {' || chr(32) || chr(124) || chr(32) || '.join(_BAR(c) for c in 'abcd')} || ' | ' || CASE WHEN least(a, b, c, d) >= 3 THEN 'yes' ELSE '**no** (' || CASE least(a, b, c, d) WHEN a THEN 'completeness' WHEN b THEN 'consistency' WHEN c THEN 'actuality' ELSE 'reliability' END || ')' END || ' | include |' AS line FROM {_SCORED}")
def quality_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = lambda c: (1 + F.coalesce(c, F.lit(0)) % 5).cast("int")
    rows = both.groupBy(F.col("source").alias("name")).agg(score(F.count("*")).alias("completeness"), score(F.count("quality")).alias("consistency"), score(F.sum("quality")).alias("actuality"), score(F.sum("toxic")).alias("reliability"))
    return report.quality_lines(rows.withColumn("decision", F.lit("include")))


@query("""
SELECT conv_id, turn, role, 'Estimate the work.' || CASE turn % 3 WHEN 0 THEN chr(10) || 'Name the rules that apply.' WHEN 1 THEN chr(10) || 'Use technical terms.' ELSE '' END || chr(10) || 'Answer with a table.' || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Be brief.' ELSE '' END || CASE WHEN turn % 4 = 0 THEN chr(10) || 'Technologies: spark, sql.' ELSE '' END || CASE WHEN turn % 5 = 0 THEN chr(10) || 'So far: ' || role ELSE '' END || chr(10) || 'Request: ' || text AS prompt FROM conversations
""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    tier = F.when(t % 3 == 0, "regulated").when(t % 3 == 1, "developer").otherwise("standard")
    known = F.when(t % 4 == 0, F.array(F.lit("spark"), F.lit("sql"))).otherwise(F.array().cast("array<string>"))
    made = report.prompt(F.col("text"), tier, F.lit("table"), F.when(t % 2 == 0, "brief").otherwise("usual"), known, F.when(t % 5 == 0, F.col("role")).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", made.alias("prompt"))


_FILED = f"""
SELECT 'transcripts' AS source, (conv_id // 50)::VARCHAR AS bucket, count(*) AS units, count(DISTINCT role) AS speakers, sum(length({_TURN}))::BIGINT AS chars FROM conversations GROUP BY 2
UNION ALL SELECT 'contracts', (doc_id // 200)::VARCHAR, count(*), 0, sum(length(trim(regexp_replace(text, '^\\n|\\n$', '', 'g'))))::BIGINT FROM documents GROUP BY 2
"""
_TEXTS = [s for s in SOURCES if s["name"] in ("transcripts", "contracts", "nothing_yet")]


def _units(rows: DataFrame) -> DataFrame:
    """Units by source and bucket, of files (or units of files) from the data source."""
    by = [F.regexp_extract("document", "/(transcripts|contracts)/", 1).alias("source"), F.regexp_extract("document", "bucket=([0-9]+)", 1).alias("bucket")]
    return rows.groupBy(*by).agg(F.count("*").alias("units"), F.countDistinct("speaker").alias("speakers"), F.sum(F.length("content")).alias("chars"))


@query(_FILED)
def catalog_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    files_ = folders.catalog_files(spark, _TEXTS, lay_out(spark, sf_dir, ("transcripts", "contracts")))
    return _units(ingest.units(files_, _TEXTS)[0])


@query(_FILED)
def stream_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = Scope(spark, "files")
    root, out = scope.folder("lake"), scope.folder("units")
    for part in (F.col("bucket") % 2 == 0, F.col("bucket") % 2 == 1):
        lay_out(spark, sf_dir, ("transcripts", "contracts"), root, part)
        units = ingest.units(folders.catalog_files(spark, _TEXTS, root, stream=True), _TEXTS)[0]
        units.writeStream.format("parquet").option("path", out).option("checkpointLocation", scope.folder("state")).trigger(availableNow=True).start().awaitTermination()
    return _units(spark.read.schema(units.schema).parquet(out))


def _made_pdfs(batches):
    for batch in batches:
        ids, made = batch.column(0).to_pylist(), []
        for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
            data = make_pdf(text or "", packed=i % 2 == 1, damaged=i % 3 == 0)
            made.append(data[: len(data) // 3] if i % 10 == 9 else data)
        yield pa.RecordBatch.from_arrays([pa.array([f"lake://pdf/{i}.pdf" for i in ids]), pa.array(made, pa.binary())], names=["path", "content"])


# Of documents a PDF each; every third has a damaged table of objects, every tenth is cut off and has no text.
@query(r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, length(trim(coalesce(text, ''), chr(10) || ' ')) < 30 AS few FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(lines), 40)) // 40 + 1 AS page, array_to_string(list_slice(lines, (page - 1) * 40 + 1, page * 40), chr(10)) AS t FROM d WHERE doc_id % 10 <> 9 AND NOT few)
SELECT doc_id, 'page-' || lpad(page::VARCHAR, 4, '0') AS unit_key, CASE WHEN doc_id % 3 = 0 THEN 'scan' ELSE 'table' END AS way, md5(trim(t, chr(10))) AS content_md5 FROM p
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM d WHERE doc_id % 10 = 9 OR few
""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[\x00\r\f\x0B]", " ").alias("text"))
    found = pdf.pdf_texts(docs.mapInArrow(_made_pdfs, "path string, content binary"))
    rows = found.select(F.regexp_extract("path", "([0-9]+)[.]pdf$", 1).cast("long").alias("doc_id"), "way", F.posexplode_outer("pages").alias("n", "content"))
    return rows.select("doc_id", F.format_string("page-%04d", F.col("n") + 1).alias("unit_key"), "way", F.md5(F.col("content").cast("binary")).alias("content_md5")).withColumn("unit_key", F.when(F.col("way").isNotNull(), F.col("unit_key")))
