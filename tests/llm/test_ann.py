import numpy as np
import pytest

from millrace.llm import ann


def brute(rows, queries, k):
    out = []
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    for q in queries:
        if q in ok:
            scores = sorted(((-float(sum(a * b for a, b in zip(ok[q], v, strict=True))), i) for i, v in ok.items() if i != q))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(5), rng.random(7)
    got = ann.walk(a, b, np.ones(35, int), 35)
    sums = [a[c // 7] + b[c % 7] for c in got]
    assert sorted(got) == list(range(35)) and sums == sorted(sums)
    assert len(ann.walk(a, b, np.ones(35, int), 4)) == 4


@pytest.mark.parametrize("groups", [1, 7])
def test_all_cells_give_the_exact_result(spark, groups, monkeypatch):
    monkeypatch.setattr(ann, "HITS", 100)
    monkeypatch.setattr(ann, "VECTORS", 32)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(50)]  # equal vectors
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, range(0, 410, 20), 10)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=10, share=1.0, centroids=4, groups=groups, query_rows=8).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in got], [w[3] for w in want])


def recall_of(rows, got, k):
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    place, mine = {i: p for p, i in enumerate(ids.tolist())}, {}
    for r in got:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in mine.items():
        s = matrix @ matrix[place[q]]
        s[place[q]] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:k]].tolist()) & found)
    return hit / (k * len(mine))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r[0], list(r[1])) for r in df.select("vec_id", "embedding").collect()]
    assert recall_of(rows, ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect(), 20) >= 0.9


def test_vectors_with_structure_need_few_cells():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 32))
    vectors = centres[rng.integers(0, 200, 20_000)] + 0.2 * rng.normal(size=(20_000, 32))
    index = ann.MultiIndex(vectors[:4000], 64)
    share = index.share(vectors[:4000], len(vectors), 20, 0.93)
    assert share < 0.05
    sizes = np.bincount(index.assign(vectors), minlength=index.cells)
    rows, hits = vectors[::400], 0
    for q, cells in zip(rows, index.probe(rows, sizes, int(share * len(vectors))), strict=True):
        near = np.argsort(-(vectors @ q))[:20]
        hits += np.isin(index.assign(vectors[near]), cells).sum()
    assert hits / (20 * len(rows)) >= 0.9


def test_odd_vectors_and_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [2.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (None, [5.0, 5.0, 5.0]), (3, [1.0]), (4, []), (5, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, cell int")
    got = ann.nearest(df, df, k=5, share=1.0).collect()
    width = {len(v) for i, v in rows if i is not None and v and any(r["vec_id"] == i for r in got)}
    assert width == {3} and {r["query_id"] for r in got} == {1, 2, 5}
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 5] == [(1, 21.0), (1, 18.0), (2, 18.0)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, score double")
    assert ann.nearest(df, df).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, one).count() == 0
