import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text, grams=1, buckets=10_000):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + g]) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]
    return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, grams=1, buckets=10_000, least=20, share=Fraction(1, 10)):
    docs = [(i, *found(t, grams, buckets)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in found(x, grams, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, bs in docs:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: math.floor(share * len(able))]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(spark, rows, target, **options):
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


def made(texts, seed, n=300):
    rnd = random.Random(seed)
    rows = [(i, texts(rnd.randint(0, 80), rnd.randint(0, 60))) for i in range(n)]
    rows += [(None, texts(5, 30)), (None, None), (n, None), (n + 1, ""), (n + 2, "!! -- \x00"), (n + 3, "Été ÉTÉ 漢字 x_y\x7fz 12 " * 9), rows[3], rows[3], (4, texts(4, 33))]
    return rows


@pytest.mark.parametrize("options", [{}, {"grams": 2, "buckets": 97, "least": 3}, {"grams": 3, "share": Fraction(1, 2)}])
def test_against_brute_force(spark, texts, options):
    rows, target = made(texts, 1), [texts(k, 12) for k in range(20)] + [None, ""]
    given = {("least_words" if k == "least" else k): v for k, v in options.items()}
    assert run(spark, rows, target, **given) == brute(rows, target, **options)


def test_small_tables(spark, texts):
    rows = made(texts, 2, 30)
    assert run(spark, rows, [], share=Fraction(1)) == brute(rows, [], share=Fraction(1))
    assert run(spark, [], [texts(1, 5)]) == []
    assert all(r[4] is None for r in run(spark, rows[:9], rows[0][1:]))


def test_equal_scores_go_by_id(spark, texts):
    rows = [(7, texts(1, 30))] * 40 + [(8, texts(1, 30))]
    got = run(spark, rows, [texts(2, 9)], share=Fraction(1, 2))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21)) and got == brute(rows, [texts(2, 9)], share=Fraction(1, 2))


def test_very_long_text(spark, texts):
    rows = [(1, texts(1, 300_000)), (2, "x" * 2_000_000), *((k, texts(k, 25)) for k in range(3, 30))]
    assert run(spark, rows, [texts(1, 50)]) == brute(rows, [texts(1, 50)])


def test_ranks_cross_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"))
    got = resampling.ranked(df, [F.col("score").desc(), F.col("id").asc()]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001))
    assert [(-r["score"], r["id"]) for r in got] == sorted((-r["score"], r["id"]) for r in got)


def test_odd_rows(odd, empty, spark):
    target = spark.createDataFrame([("the people of time",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = brute(rows, ["the people of time"])
    assert sorted(map(tuple, resampling.resample(odd, target).collect()), key=str) == want
    assert resampling.resample(empty, target).count() == 0
    renamed = odd.select(F.col("doc_id").alias("rank"), F.col("text").alias("found"), F.lit(1).alias("words"), F.lit(2).alias("n_words"))
    assert sorted(map(tuple, resampling.resample(renamed, target.withColumnRenamed("text", "rank"), "rank", "found", "rank").collect()), key=str) == want


def test_query_and_sql(spark, texts, tmp_path):
    rows, target = made(texts, 3), [texts(k, 12) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = queries.op12_importance_resampling(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, target)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.OP12_SQL})").fetchall(), key=str) == brute(rows, target)
