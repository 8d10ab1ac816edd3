import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def brute_targets(sizes, cycle=(5, 2, 1), share=1.5, most=2.0):
    """Resharing of the excess, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    full, rest = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / total for s in free}
        for s in over:
            full[s] = most * sizes[s]
        rest = share * sum(sizes.values()) - sum(full.values())


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 200, "c": 50, None: 7}, {"a": 10}, {"b": 1000, "a": 1, "c": 1, "d": 500, "e": 0}])
def test_targets_match_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_inverted_schedules(spark):
    for k, schedule in enumerate(mixing.SCHEDULES):
        for x in (0.0, 0.1, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing.invert_demand(F.lit(x), F.lit(k))).first()[0]
            total = done = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
                total += (t1 - t0) * (w0 + w1) / 2
                s = min(max(t - t0, 0.0), t1 - t0)
                done += s * w0 + (w1 - w0) * s * s / (2 * (t1 - t0))
            assert abs(done / total - x) < 1e-9


def test_taken_words_come_near_targets(spark, texts):
    rows = [(k, texts(k, 5 + k * 7 % 60), f"s{min(k % 10, 4)}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df, bucket_rows=20).collect()
    again = mixing.plan_mix(df.repartition(5), bucket_rows=20).collect()
    assert {(r["id"], r["taken"]) for r in plan} == {(r["id"], r["taken"]) for r in again}
    source = {r[0]: r[2] for r in rows}
    by = Counter()
    for r in plan:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and all(0 <= p <= 1 for p in r["positions"])
        by[source[r["id"]]] += r["taken"]
    for r in plan:
        assert abs(by[source[r["id"]]] - r["target"]) <= 64
    mixed = mixing.mix(df, bucket_rows=20)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["id"]: r["passes"] for r in plan if r["passes"]})


def test_the_query_comes_from_the_sorted_mix(spark, texts):
    rows = [(k, texts(k, 5 + k * 7 % 60), f"s{min(k % 10, 4)}") for k in range(300)] + [(7, texts(7, 54), "s4")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df, bucket_rows=20)
    order = mixing.training_order(plan).collect()
    at = 0
    for r in sorted(order, key=lambda r: (r["position"], r["id"], r["th"], r["begin"])):
        assert r["begin"] == at
        at += r["size"]
    positions = sorted(p for r in plan.collect() for p in r["positions"])
    assert sorted(r["position"] for r in order) == positions
    got = mixing.taken_in_order(plan).collect()
    assert sorted((r["id"], r["taken"]) for r in got) == sorted((r["id"], r["taken"]) for r in plan.collect())
    assert all((r["first_position"] < 0) == (r["taken"] == 0) or r["size"] == 0 for r in got)
    assert "sqrt" in mixing.taken_in_order(plan)._jdf.queryExecution().optimizedPlan().toString().lower() + plan._jdf.queryExecution().optimizedPlan().toString().lower()


def test_null_ids_spread_over_buckets(spark, texts):
    df = spark.createDataFrame([(None, texts(k, 20), "a") for k in range(400)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(df, bucket_rows=10).collect()
    words = sum(r["size"] for r in plan)
    assert abs(sum(r["taken"] for r in plan) - 1.5 * words) <= 40 and {r["passes"] for r in plan} == {1, 2}


def test_odd_rows(odd, empty):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in plan)
    got = mixing.taken_in_order(mixing.plan_mix(odd)).collect()
    assert sorted((r["id"] or -1, r["taken"]) for r in got) == sorted((r["id"] or -1, r["taken"]) for r in plan)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["passes"] for r in plan)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_repeated_rows_are_linear(spark, texts):
    df = spark.createDataFrame([(1, texts(1, 20), "a", k) for k in range(20_000)] + [(2, texts(2, 20), "a", -1)], "doc_id long, text string, source string, k int")
    start = time.perf_counter()
    mixed = mixing.mix(df)
    plan = mixing.plan_mix(df).collect()
    assert mixed.count() == sum(r["passes"] for r in plan)
    got = mixing.taken_in_order(mixing.plan_mix(df))
    assert sorted(r["taken"] for r in got.collect()) == sorted(r["taken"] for r in plan)
    # with the positions of all copies for each of them it takes many minutes
    assert time.perf_counter() - start < 120
    assert mixed.groupBy("k").count().agg({"count": "max"}).first()[0] <= 2
