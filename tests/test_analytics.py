import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.functions.firsts import first_k, first_values
from millrace.operators import analytics, needles


def test_percentiles(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([rng.randrange(5000) / 4, 7.25, None])) for _ in range(4000)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    percents = (1, 50, 95, 100)
    want = {g: tuple(sorted(vs)[math.ceil(p * len(vs) / 100) - 1] for p in percents) for g, vs in groups.items()}
    for accuracy in (5, 100, 10_000):
        got = analytics.percentiles(df, ["g"], "v", percents, accuracy)
        assert got.columns == ["g", "p1", "p50", "p95", "p100"]
        assert {r["g"]: (r["p1"], r["p50"], r["p95"], r["p100"]) for r in got.collect()} == want
    assert analytics.percentiles(df.limit(0), ["g"], "v", percents).count() == 0
    # a sketch that is wrong costs time, not the result
    monkeypatch.setattr(analytics.F, "percentile_approx", lambda c, shares, accuracy: F.array(*[F.min(c)] * len(shares)))
    wrong = analytics.percentiles(df, ["g"], "v", percents)
    assert {r["g"]: (r["p1"], r["p50"], r["p95"], r["p100"]) for r in wrong.collect()} == want


def test_only_values_near_a_percentile_are_sorted(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"), F.lit(1).alias("g"))
    got = analytics.percentiles(df, ["g"], "v", (50,), 1000)
    assert got.first()["p50"] == sorted(k * 7919 % 100_003 for k in range(100_000))[49_999]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "between" not in plan and plan.count("Window [") == 1


def test_needles_against_a_loop(spark):
    rng = random.Random(3)
    letters = "abcé漢 "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(k, rng.choice([text(rng.randint(0, 60)), None, ""])) for k in range(200)] + [(999, "aaa" * 3000)]
    words = [text(rng.randint(0, 6)) for _ in range(150)] + [None, "aaaaaa", "aaab"]
    got = needles.found_in(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame(texts, "id long, t string"), "w", "id", "t")
    assert sorted((r["key"], r["needle"]) for r in got.collect()) == sorted((k, w) for k, t in texts for w in {w for w in words if w} if t and w in t)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and plan.count("Join Inner, contains") == 0


def test_first_rows_of_groups(spark):
    rows = [(k % 3 if k % 7 else None, -k if k % 5 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, v long")
    want = {g: sorted(v for x, v in rows if x == g and v is not None)[:4] for g in (0, 1, 2, None)}
    assert {r["g"]: r["firsts"] for r in first_values(df, ["g"], F.col("v"), 4).collect()} == want
    got = first_k(df.where("v is not null"), ["g"], [F.desc("v")], 2)
    assert sorted((str(r["g"]), r["v"]) for r in got.collect()) == sorted((str(g), v) for g in (0, 1, 2, None) for v in sorted((v for x, v in rows if x == g and v is not None), reverse=True)[:2])
    # few rows of a group leave each task
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_live_facts_are_dealt_to_all_partitions(spark):
    from pyspark.sql import functions as F

    from millrace.operators import evaluation

    facts = spark.range(40).selectExpr("id as o", "'k' as key", "1 as introduced_at", "cast(if(id % 2 = 0, 2, null) as int) as superseded_at").hint("merge")
    turns = spark.range(80).selectExpr("id div 2 as o", "cast(id % 2 + 1 as int) as turn")
    got = evaluation.live_facts(facts, turns, "o").withColumn("p", F.spark_partition_id()).collect()
    assert {(r["o"], r["turn"]) for r in got} == {(o, t) for o in range(40) for t in (1, 2) if o % 2 or t == 1}
    assert len({r["p"] for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
