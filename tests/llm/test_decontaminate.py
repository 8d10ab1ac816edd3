from itertools import combinations

import numpy as np
import pytest

from millrace.llm import decontaminate as d


@pytest.mark.parametrize(("n", "wrong"), [(13, 2), (12, 2), (11, 2), (10, 2), (9, 1), (8, 1)])
def test_masks_hit_all_tolerated_substitutions(n, wrong):
    assert n - wrong >= d.need(n)
    for bad in combinations(range(n), wrong):
        assert any(all(i + o not in bad for o in mask) for mask in d.MASKS for i in range(n - mask[-1]))


def brute(docs, items):
    out = {}
    for i, text in docs:
        own = d.tokens(text)
        for j, item in items:
            other = d.tokens(item)
            if not other:
                continue
            w = min(d.WINDOW, len(other))
            good = any(sum(own[s + k] == other[o + k] for k in range(w)) >= d.need(w) for s in range(len(own) - w + 1) for o in range(len(other) - w + 1))
            if good:
                out[i, j] = True
    return set(out)


def test_overlaps_match_brute_force(spark, texts):
    items = [(k, texts(500 + k, 30)) for k in range(5)] + [(9, "too short an item"), (10, None), (11, texts(600, 9))]
    changed = items[1][1].split()
    changed[10], changed[16] = "x", "y"
    docs = [(1, texts(1, 50) + " " + items[0][1]), (2, texts(2, 20) + " ".join(changed) + texts(3, 9)), (3, texts(4, 200)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:13]).upper() + "!"), (7, "An " + items[7][1] + " end"), (8, " ".join(items[3][1].split()[:10])), (12, "This is too short, an item! " + texts(5, 40)), (13, "too short the item")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (d.BLOCK, 200):
        got = {(r["id"], r["item_id"]) for r in d.benchmark_overlaps(df, bench, block=block).collect()}
        assert got == want and {(1, 0), (2, 1), (6, 2), (7, 11)} <= want
    assert (12, 9) in want and (13, 9) not in want
    kept = {r["doc_id"] for r in d.decontaminate(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, j in want if j != 9}
    assert 12 not in {r["doc_id"] for r in d.decontaminate(df, bench, least_words=4).collect()}


def test_repetitive_texts_are_no_product():
    index = d.Index([(1, "word " * 60), (2, "a b " * 30)])
    words, offsets = d.hash_words(["word " * 200_000, "a b " * 20_000, "c word a b"], d._PART)
    at, _ = index.hits(words, offsets)
    assert len(at) < 2_000_000
    assert {(t, i) for t, i, *_ in index.overlaps(words[: offsets[1]][:3000], np.array([0, 3000]))} == {(0, 0)}


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, odd.where("doc_id = 13").first()["text"]), (None, None)], "item_id long, text string")
    assert {r["id"] for r in d.benchmark_overlaps(odd, bench).collect()} == {13}
    kept = d.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert d.benchmark_overlaps(empty, bench).count() == 0 and d.benchmark_overlaps(odd, bench.limit(0)).count() == 0
