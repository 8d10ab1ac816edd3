import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=40, least_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    got = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


def made(seed, n=150):
    rnd = random.Random(seed)
    shared = [f"{w} shared line of the corpus {'é' * (k % 7)} number {k:010d}" for k, w in enumerate(["Été", "ABC", " x", "ÀB"] * 6)]
    rows = []
    for i in range(n):
        lines = [rnd.choice([rnd.choice(shared), rnd.choice(shared).upper(), f"\t{rnd.choice(shared)} \r", f"own {rnd.random()} line that is over forty characters long", "short", "", "the most frequent line of all, found in a third of texts"]) for _ in range(rnd.randint(1, 12))]
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice(["\n".join(lines)] * 9 + [None, "", "\n", "a\n\n", " " + " " * 60])))
    return rows + rows[:10]


@pytest.mark.parametrize(("seed", "hot"), [(1, 10_000), (2, 20), (3, 1), (4, 1_000_000)])
def test_against_brute_force(spark, seed, hot):
    rows = made(seed)
    assert run(spark, rows, hot=hot) == brute(rows)
    assert run(spark, rows, hot=hot, least_docs=2, least_chars=3) == brute(rows, 3, 2)


def test_thresholds_and_the_largest_id(spark):
    line = "x" * 40
    rows = [(i, f"{line}\nkept {i}\n {line}") for i in range(1, 6)]
    assert run(spark, rows[:4]) == brute(rows[:4]) and all(r[2] == 0 for r in run(spark, rows[:4]))
    got = run(spark, rows)
    assert [(r[0], r[2]) for r in got] == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 0)] and got[0][3] == "kept 1"
    assert all(r[2] == 0 for r in run(spark, [(i, "x" * 39) for i in range(9)]))
    # rows that share an id are one document
    assert all(r[2] == 0 for r in run(spark, [(i % 4, f"{line}\n{i}") for i in range(20)]))
    # stripped and lower-cased in A-Z only: É and é are different keys
    up, low = "É" * 40, "é" * 40
    assert all(r[2] == 0 for r in run(spark, [(i, up if i < 4 else low) for i in range(8)]))


def test_very_long_texts(spark):
    lines = [f"line {k % 4000} of a very long text, over forty characters" for k in range(60_000)]
    rows = [(i, "\n".join(lines[i:] + [f"only in {i}"])) for i in range(5)] + [(9, "a" * 3_000_000 + "\n" + " " * 500_000)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(odd, empty):
    got = line_dedup.drop_shared_lines(odd).collect()
    assert len(got) == odd.count() and line_dedup.drop_shared_lines(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == brute(rows)
    renamed = odd.select(F.col("doc_id").alias("h1"), F.col("text").alias("drops"), F.lit(1).alias("at"), F.lit(2).alias("th_d"))
    assert sorted(map(tuple, line_dedup.drop_shared_lines(renamed, "h1", "drops").collect()), key=str) == brute(rows)


def test_no_python_in_the_plan(odd):
    plan = line_dedup.drop_shared_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_and_sql(spark, tmp_path):
    rows = made(7)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in queries.op13_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=str)
    assert got == sorted([(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(rows)], key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.OP13_SQL})").fetchall(), key=str) == got
