import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import analytics, attachments, guardrails, privacy, prompts, report, sessions, validation


def test_templates(spark):
    rows = spark.createDataFrame([(1, "web", "x", "table", "", "hello", None, "lawyers"), (2, "app", "y", "list", "known", "bye", "a.txt", None)], "k int, project_type string, detail_level string, output_format string, metadata string, transcript string, attachments string, tier string")
    got = {r["k"]: r for r in prompts.render(rows, "session", "v3").collect()}
    assert got[1]["system"] == "Estimate the work of a web project, turn by turn.\nLevel of detail: x. Form of the answer: table.\nReaders: lawyers." and got[1]["user"] == "hello"
    assert got[2]["system"].endswith("table.\nKnown so far:\nknown".replace("table", "list")) and got[2]["user"] == "bye\nAttachments:\na.txt" and len(got[2]["system_hash"]) == 12
    assert prompts.render(rows, "session", "v2").where("k = 1").first()["system"].endswith("table.")
    with pytest.raises(KeyError, match="session v9"):
        prompts.render(rows, "session", "v9")
    with pytest.raises(Exception, match="needs transcript"):
        prompts.render(rows.withColumn("transcript", F.lit(None).cast("string")), "session", "v2").collect()
    said = spark.createDataFrame([("", "a", "b", None, "x")], "metadata string, question string, answer string, summary string, said string")
    assert prompts.render(said, "facts", "v1").first()["system"] is None and prompts.render(said, "summary", "v1").first()["user"] == "Said since:\nx"


def test_audit_with_a_run(spark):
    q = "completeness int, consistency int, actuality int, reliability int"
    catalog = spark.createDataFrame([("b", "include", "json", "monthly", 10, True, 4, 4, 4, 4), ("a", "include", "txt", "daily", 9, False, 4, 2, 4, 4)], f"name string, decision string, format string, refresh string, lag_days int, contains_pii boolean, {q}")
    run = spark.createDataFrame([("a", "include", *[3] * 8, "x.txt: broken"), ("b", "include", *[1] * 8, None)], "source string, decision string, files_seen long, units_parsed long, units_kept long, documents long, records_valid long, records_quarantined long, records_discarded long, entities_replaced long, errors string")
    divergent = spark.createDataFrame([("b", "B-2"), ("b", "B-1"), ("b", "B-1")], "source string, id string")
    text = report.audit(catalog, run, divergent).first()["markdown"]
    parts = text.split("\n\n## ")
    assert [p.split("\n")[0] for p in parts[1:]] == ["Quality", "Freshness", "Included though not ready", "Included", "Personal data", "Last run", "Versions that differ", "Errors"]
    assert parts[0].endswith("2 sources: 2 included, 0 excluded, 0 under review")
    assert "- **`a`** weak in consistency (2/5): no reason given" in text and "| `a` | include | 3 | 3 | 3 | 3 | 3 | 3 | 3 | 3 |" in text and "- `b`: B-1, B-2 (the latest date stands)" in text and text.endswith("- `a`: x.txt: broken")
    assert report.audit(catalog.limit(0)).first()["markdown"].endswith("0 sources: 0 included, 0 excluded, 0 under review")


def test_small_rules_of_sessions(spark):
    one = spark.range(1)
    lists = F.array(F.array(F.lit("a"), F.lit("A"), F.lit(None)), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("a")))
    none = F.lit(None).cast("string")
    r = one.select(sessions.union_exact(lists).alias("u"), sessions.metadata_json(F.lit("é \"x\""), F.lit(3), F.array(F.lit("Go")), none, F.array().cast("array<string>"), F.array(F.lit("b"))).alias("j")).first()
    assert r["u"] == ["a", "A", "b"]
    assert json.loads(r["j"]) == {"project_name": 'é "x"', "assumed_team_size": 3, "mentioned_technologies": ["Go"], "agreed_scope": None, "explicit_constraints": [], "rejected_options": ["b"]}
    models = ["openai/x", "gpt-4o", "o3-mini", "anthropic/claude", "claude-x", "gemini-1", "other", None, ""]
    got = spark.createDataFrame([(k, m) for k, m in enumerate(models)], "k int, m string").select("k", sessions.provider(F.col("m")).alias("p")).orderBy("k").collect()
    assert [r["p"] for r in got] == ["openai", "openai", "openai", "anthropic", "anthropic", "google", None, None, None]


def test_projection_to_a_contract(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double")
    assert validation.projected(df, "c double, a long").columns == ["c", "a"]
    with pytest.raises(TypeError, match="a: bigint instead of int; d: missing instead of string"):
        validation.projected(df, "a int, d string")


def test_rules_and_generators_that_a_user_adds(spark):
    df = spark.createDataFrame([("docker and kafka", 9), ("under NDA", 1), ("plain", None)], "t string, team int")
    none = F.array().cast("array<string>")
    rules = [("big", "wide", lambda text, scope, technologies, team: team > 5), *guardrails.TIER_RULES]
    assert [tuple(r["x"]) for r in df.select(guardrails.tier(F.col("t"), F.lit(""), none, F.col("team"), rules).alias("x")).collect()] == [("wide", "big"), ("confidential", "nda"), ("standard", "default")]
    assert [r["x"] for r in df.select(guardrails.is_anchor(F.col("t")).alias("x")).collect()] == [False, True, False]
    judged = F.when(F.col("t") == "plain", True).when(F.col("t") == "under NDA", False)
    assert [r["x"] for r in df.select(guardrails.is_anchor(F.col("t"), judged).alias("x")).collect()] == [False, False, True]
    made = privacy.GENERATORS | {"PLACE": lambda d: F.concat(F.lit("Town "), F.substring(d, 1, 2))}
    r = spark.range(1).select(privacy.pseudonym(F.lit("PLACE"), F.lit("abcdef0123"), made).alias("a"), privacy.pseudonym(F.lit("PLACE"), F.lit("abcdef0123")).alias("b")).first()
    assert (r["a"], r["b"]) == ("Town ab", "REDACTED-abcdef01")


def test_small_rules_of_reports(spark):
    texts = spark.createDataFrame([("x" * 100,), ("a few short words",), ("",), (None,)], "t string")
    assert [r["w"] for r in texts.select(attachments.warning(F.col("t")).alias("w")).collect()] == ["long words", None, None, None]
    rows = spark.createDataFrame([("10", 1.0), ("9", 2.0), ("b", None), (None, 4.0), ("a", 5.0)], "k string, v double")
    assert [r["k"] for r in analytics.in_report_order(rows, "k").collect()] == ["9", "10", "a", "b", None]
    means = {r["k"]: r["m"] for r in rows.groupBy("k").agg(analytics.mean_or_nan(F.col("v")).alias("m")).collect()}
    assert means["9"] == 2.0 and means["b"] != means["b"]
    given = attachments.route(spark.createDataFrame([(1, "a.txt", "some words that are long enough to be of use here", "docx"), (1, "b.pdf", "", "pdf"), (2, "c.docx", None, "docx")], "r int, filename string, text string, kind string"))
    got = {r["r"]: (r["block"], r["notes"]) for r in attachments.block(given, "r", "filename").collect()}
    assert got[1][0].startswith("<attachment filename='a.txt'>") and got[1][1] == ["b.pdf: no text"] and got[2] == ("", ["c.docx: no text"])


def test_facts_with_line_ends_quotes_and_nulls_as_in_sql(spark, tmp_path):
    import duckdb

    from millrace.plans import registry

    texts = {1: ["Erha.\nThe onea. on"], 2: ['say "x" \\'], 3: ['"x" and\tmore'], 4: [None, "later on"], 5: [None], 6: ["\\n x y", "x\ny \x01"], 7: [',"'], 8: [""], 9: ["é on", None]}
    rows = [(c, k, "user", t) for c, said in texts.items() for k, t in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: (w, r) for c, w, r in duckdb.sql(registry.ORACLES["known_constraints"].replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")).fetchall()}
    got = {r["conv_id"]: (r["constraints"], r["recalled"]) for r in registry.QUERIES["known_constraints"](spark, str(tmp_path)).collect()}
    assert got == want and got[1][1] and not got[3][1]
