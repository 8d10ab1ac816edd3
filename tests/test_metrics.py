import pytest
from pyspark.sql import functions as F

from millrace.operators import embedding, metrics


def test_a_metric_that_raises_is_a_failed_row(spark):
    rows = spark.createDataFrame([(1, "120", 2), (2, "90", 0), (3, None, 5), (4, "nan", 1), (5, "12,5", None)], "id long, ms string, n long")

    def share(o):
        return 1 / o["n"], o["n"] > 1, f"n={o['n']}"

    given = [metrics.Metric("share", share), metrics.Metric("latency", metrics.within(F.col("ms"), 100, "ms")), metrics.Metric("empty", lambda o: {}["no"])]
    got = {(r["id"], r["place"]): (r["name"], r["score"], r["passed"], r["details"]) for r in metrics.run_metrics(rows, ["id"], given).collect()}
    assert len(got) == 15 and [got[1, k][0] for k in range(3)] == ["share", "latency", "empty"]
    assert got[1, 0] == ("share", 0.5, True, "n=2") and got[2, 0] == ("share", 0.0, False, "metric raised ZeroDivisionError: division by zero") and got[5, 0][3].startswith("metric raised TypeError")
    assert got[1, 1] == ("latency", 0.0, False, "120.00 ms, 20.00 ms over") and got[2, 1] == ("latency", 1.0, True, "90.00 ms, 10.00 ms left")
    assert [got[k, 1][1:] for k in (3, 4, 5)] == [(0.0, False, "no value"), (0.0, False, "not a number: nan"), (0.0, False, "not a number: 12,5")]
    assert all(got[k, 2] == ("empty", 0.0, False, "metric raised KeyError: 'no'") for k in range(1, 6))
    plain = metrics.run_metrics(rows, ["id"], given[1:2])
    assert plain.count() == 5 and "Python" not in plain._jdf.queryExecution().executedPlan().toString()


def test_answers_out_of_order_slow_down_and_fail():
    calls = []

    def vectorise(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise embedding.SlowDown
        return [(k, [float(len(t))]) for k, t in reversed(list(enumerate(texts)))]

    assert embedding.ask(vectorise, ["a", "bbb", ""], 1, (0.0, 0.0)) == [[1.0], [3.0], [0.0]] and calls == [3, 3, 3]
    with pytest.raises(embedding.SlowDown):
        embedding.ask(lambda t: (_ for _ in ()).throw(embedding.SlowDown), ["a"], 1, (0.0,))
    with pytest.raises(KeyError):  # not repeated
        embedding.ask(lambda t: {}["key"], ["a"], 1, (0.0,))
    with pytest.raises(ValueError, match="dimensions"):
        embedding.ask(lambda t: [(0, [1.0, 2.0])], ["a"], 1)
    with pytest.raises(ValueError, match="places"):
        embedding.ask(lambda t: [(0, [1.0])], ["a", "b"], 1)


def test_requests_are_cut_across_batches(spark):
    df = spark.range(0, 1050, 1, 2).select("id", F.when(F.col("id") % 50 != 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = embedding.embed(df, lambda texts: [(k, [float(len(t)), float(len(texts))]) for k, t in enumerate(texts)], 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["id"] for r in got) == list(range(1050))
    assert all(r["embedding"][0] == len(r["text"] or "") for r in got)
    assert sorted({(r["request"], r["embedding"][1]) for r in got}) == [*((k, 100.0) for k in range(5)), (5, 25.0)]
    assert embedding.embed(df.limit(0), lambda t: [], 2).count() == 0
