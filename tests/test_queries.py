"""Every query that has SQL, against DuckDB on the same tables."""

import hashlib
import os
import re
import subprocess
import sys
import unicodedata

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: repr(round(x, 6)) if isinstance(x, float) else repr(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)
    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_nfkc(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["nfkc_md5"] for r in registry.QUERIES["nfkc_normalise"](spark, SF).collect()}
    assert got == {k: hashlib.md5(unicodedata.normalize("NFKC", t).encode()).hexdigest() for k, t in texts.items()}


def test_pseudonymised_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    for r in registry.QUERIES["pseudonymise"](spark, SF).collect():
        assert all(m.endswith("@example.org") for m in mail.findall(r["text"]))
        assert r["n_spans"] >= len(mail.findall(texts[r["doc_id"]])) and (r["n_spans"] or r["text"] == texts[r["doc_id"]])


def test_html_sections(spark):
    block = re.compile(r"(?is)<(h[1-6]|p)[^>]*>(.*?)</\1>")
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        section, title = 0, None
        for tag, body in block.findall(r["html"]):
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("<[^>]*>", " ", body)).strip(" ")
            if tag.lower() != "p":
                section, title = section + 1, text
            old = want.get((r["page_id"], section), (title, 0, 0))
            want[r["page_id"], section] = (title, old[1] + (tag.lower() == "p"), old[2] + (len(text) if tag.lower() == "p" else 0))
    got = {(r["page_id"], r["section"]): (r["title"], r["paragraphs"], r["chars"]) for r in registry.QUERIES["html_sections"](spark, SF).collect()}
    assert got == want


def test_all_queries_have_sql_or_a_test_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"nfkc_normalise", "pseudonymise", "html_sections"}


def test_entry_works_without_the_llm_folder():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['millrace.llm'] = None; import __spark_entry__ as e; from millrace.plans import registry as r; assert set(e.queries()) == set(r.QUERIES) and set(e.oracle_sql()) == set(r.ORACLES)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
