import random

from pyspark.sql import functions as F

from millrace.operators import caching
from millrace.sources.storage import Scope


def test_ttl_hits_stream_over_segments(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), k, rng.randrange(5000) if k % 50 else None) for k in range(3000)]
    rows += [("tie", 9000 + k // 2, 40 * (k // 4)) for k in range(60)]
    got = caching.ttl_hits(spark.createDataFrame(rows, "key string, request_id long, at long"), "key", "at", ttl=30)
    want, since = [], {}
    for key, i, at in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        hit = at is not None and since.get(key) is not None and at < since[key] + 30
        want.append((str(key), i, hit))
        if not hit:
            since[key] = at
    assert sorted((str(r["key"]), r["request_id"], r["hit"]) for r in got.collect()) == sorted(want)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_a_stored_cache_fails_open_and_forgets(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    with Scope(spark, "cache") as scope:
        cache = caching.StoredCache(spark, scope.folder("c"), ttl=100, value="v long", buckets=4)
        asked = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
        assert [r["hit"] for r in cache.get(asked, at(0)).collect()] == [False] * 3  # there is none yet
        cache.put(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, v long"), at(1000))
        cache.put(spark.createDataFrame([("b", 5), ("c", 6)], "key string, v long"), at(1050))
        got = lambda s: {r["key"]: (r["v"], r["hit"]) for r in cache.get(asked, at(s)).collect()}
        assert got(1099) == {"a": (1, True), "b": (5, True), None: (None, False)}
        assert got(1100) == {"a": (None, False), "b": (5, True), None: (None, False)}
        assert cache.evict(at(1100)) == 1 and cache.live(at(0)).count() == 2
        cache.put(spark.createDataFrame([("a", 9)], "key string, v long"), at(1200))
        assert got(1250) == {"a": (9, True), "b": (None, False), None: (None, False)}


def test_ttl_hits_of_one_key_over_many_ranges(spark):
    rows = [(k, 7 * k if k % 13 else 7 * k + 400) for k in range(4000)]
    df = spark.createDataFrame(rows, "request_id long, at long").withColumn("key", F.lit("hot")).repartition(8)
    want, since = {}, None
    for i, at in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = since is not None and at < since + 100
        since = since if want[i] else at
    assert {r["request_id"]: r["hit"] for r in caching.ttl_hits(df, "key", "at", ttl=100).collect()} == want
