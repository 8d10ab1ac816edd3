import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, whitening


def brute(rows, components=32):
    """(n, whole numbers by row, explained, whitened up to sign) with plain numpy; deviations with Python's numbers."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in ok], float)
    n, sums = len(ok), [sum(v[j] for _, v in ok) for j in range(len(ok[0][1]))]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in ok}
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    e, b = np.linalg.eigh(cov)
    e, b = e[::-1][:components], b[:, ::-1][:, :components]
    return n, deviation, e / np.trace(cov), {i: w for (i, _), w in zip(ok, centred @ b / np.sqrt(e), strict=True)}


def check(got, rows, components=32):
    n, deviation, explained, whitened = brute(rows, components)
    k = len(explained)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-4
    mine = {i: np.zeros(k) for i in whitened}
    for r in got:
        assert r["deviation"] == deviation[r["id"]] and abs(r["explained"] - explained[r["component"] - 1]) <= 1e-9
        mine[r["id"]][r["component"] - 1] = r["whitened"]
    a, b = np.array([mine[i] for i in whitened]), np.array([whitened[i] for i in whitened])
    a = a * np.sign((a * b).sum(axis=0))  # either sign, but the same for all rows
    assert np.abs(a - b).max() < 1e-6
    assert np.abs(a.T @ a / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize(("n", "d", "parts"), [(300, 6, 1), (400, 40, 5), (50, 3, 7)])
def test_against_numpy(spark, n, d, parts):
    rng = np.random.default_rng(n)
    spread = rng.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    rows = [(i, (rng.normal(size=d) @ spread + 3).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    check(whitening.whiten(df).collect(), rows)
    check(whitening.whiten(df, components=2).collect(), rows, 2)


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1e30, 0.0, 0.0, 0.0]), (106, [1.0] * 3), (None, None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), rows)
    monkeypatch.setattr(whitening, "ROWS", 7)
    check(whitening.whiten(df).collect(), rows)
    # columns named like the operator's own, floats instead of doubles
    named = df.select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<float>").alias("whitened"), F.lit("x").alias("embedding"), F.lit(1).alias("vec_id"))
    floats = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    check(whitening.whiten(named, "n", "whitened").collect(), floats)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 100 or vec_id is null")).count() == 0
    assert whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns


def test_ties_repeats_and_rank(spark):
    one = [(i, [1.0, 2.0, 3.0]) for i in range(20)]
    assert whitening.whiten(spark.createDataFrame(one, "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame(one[:1], "vec_id long, embedding array<double>")).count() == 0
    rng = np.random.default_rng(5)
    flat = [(i, [float(a), float(2 * a), float(b), 7.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, size=(80, 2)))]
    got = whitening.whiten(spark.createDataFrame(flat + flat, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 160 * 2 and {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9
    nameless = [(None, v) for _, v in flat]
    assert len(whitening.whiten(spark.createDataFrame(nameless, "vec_id long, embedding array<double>")).collect()) == 80 * 2


def test_deviation_is_exact_beyond_64_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(900_000, 1_100_000, size=(50, 8))
    for n in (50, 10**9, 10**13):
        sums = tuple(int(s) * (n // 50) + 3 for s in x.sum(axis=0))
        fit = whitening.Fit(n, sums, np.zeros(0), np.zeros((8, 0)), 1.0)
        assert fit.deviation(x) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_blocks_are_merged_exactly():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(200, 3)) + 5
    total = 0, np.zeros(3), np.zeros((3, 3))
    for part in np.split(w, [1, 50, 51, 120]):
        mean = part.mean(axis=0)
        total = whitening.combined(total, (len(part), mean, (part - mean).T @ (part - mean)))
    assert total[0] == 200 and np.allclose(total[1], w.mean(axis=0)) and np.allclose(total[2] / 200, np.cov(w.T, bias=True))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_embedding_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check([dict(r.asDict(), id=r["vec_id"]) for r in got.collect()], rows)
