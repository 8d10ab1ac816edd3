import random
import time

import numpy as np
import pandas as pd

from millrace.llm import toxicity as t


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition: the best segment (shortest, then first),
    then the same to its left and to its right."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j, b + j, x) for a, b, x in brute_segments(scores[j:])]


def test_segments_match_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 30)
        places = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        values = [round(rng.uniform(0.5, 3), 2) for _ in places]
        scores = [-0.7] * n
        for p, v in zip(places, values, strict=True):
            scores[p] = v
        got = t.maximal_segments(places, values, -0.7)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_the_scan_is_linear():
    # isolated hits: totals fall, so no segment joins another and every search begins at the last one
    n = 100_000
    start = time.perf_counter()
    assert len(t.maximal_segments(list(range(0, 10 * n, 10)), [1.0] * n, -0.7)) == n
    # hits that rise: each joins all before it
    assert t.maximal_segments(list(range(0, 2 * n, 2)), [1.0] * n, -0.7)[0][:2] == (0, 2 * n - 1)
    assert time.perf_counter() - start < 5


def test_the_prior_covers_all_documents(spark, texts):
    rows = [(k, texts(k, 30) + (" vile" if k % 2 else " calm")) for k in range(60)]
    labelled = spark.createDataFrame([(r[1], r[0] % 2) for r in rows], "text string, toxic int")
    small = spark.createDataFrame(rows, "doc_id long, text string")
    common = small.union(spark.createDataFrame([(k, f"vile {texts(k, 30)}") for k in range(100, 2000)], small.schema))
    vile = t.words_of(["vile"])[0][0]
    score = {name: dict(zip(m.terms.tolist(), m.scores.tolist(), strict=True))[int(vile)] for name, m in (("rare", t.fit_terms(labelled, small)), ("common", t.fit_terms(labelled, common)))}
    assert score["rare"] > score["common"] > 0


def test_held_out_accuracy(spark):
    from millrace.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.1"
    got = op1_toxicity(spark, sf).where("held_out").select("doc_id", "score", "predicted").toPandas()
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.95
    up, down = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    assert ((up[:, None] > down) + 0.5 * (up[:, None] == down)).mean() > 0.93


def test_passages_and_odd_rows(spark, texts, odd, empty):
    rows = [(k, texts(k, 60) + (" vile " * 5 if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["id"]: r for r in t.score_toxicity(train, train).collect()}
    assert all((got[k]["predicted"] == 1) == (k % 3 == 0) for k in got)
    assert [(p["start"], p["until"]) for p in got[0]["passages"]] == [(60, 65)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (6, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    scored = t.score_toxicity(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert t.score_toxicity(empty, labels).count() == 0
    assert t.score_toxicity(odd, labels.limit(0)).count() == odd.count()
