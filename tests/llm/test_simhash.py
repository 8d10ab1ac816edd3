import random
import time

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.components import connected_components


def brute_fingerprint(text, k=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_majority(texts):
    for t in [None, "", "  ", "One", "ÀB c D e", texts(3, 400), "a b c d e f g a b c d", "Ǆ İ A"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_bit_sliced_groups_match_brute_force():
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for c in centres for _ in range(40)]
    cells = sorted(rng.randrange(3) for _ in fps)
    got = simhash.bit_sliced_groups(np.array(cells), np.array(fps, np.uint64), 4)
    for c in set(cells):
        rows = {i: fps[i] for i, x in enumerate(cells) if x == c}
        assert {i: int(got[i]) for i in rows} == brute_components(rows, 4)


def test_pairs_within_the_radius_share_a_key(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append(tuple(np.array([a, b], np.uint64).view(np.int64).tolist()))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~F.arrays_overlap(simhash.band_keys(F.col("a")), simhash.band_keys(F.col("b")))).count() == 0


def test_large_cells_are_split_without_losing_links(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)]
    df = spark.createDataFrame([(f,) for f in np.array(fps, np.uint64).view(np.int64).tolist()], "node long").withColumn("f0", F.col("node"))
    links = simhash.near_links(df.select(F.explode(simhash.band_keys(F.col("f0"))).alias("key"), "node", "f0"), ["f0"], 4, cell=7)
    assert connected_components(links).select("root").distinct().count() == 1


def test_components_of_odd_rows(odd, empty):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    fps = {k: brute_fingerprint(t) for k, (_, t) in enumerate(texts)}
    groups = brute_components(fps, 4)
    want = {}
    for k, (i, _) in enumerate(texts):
        ids = [texts[j][0] for j in groups if groups[j] == groups[k] and texts[j][0] is not None]
        want.setdefault((i, fps[k]), min(ids) if ids else None)
    for r in rows:
        assert want[r["id"], int(r["fp"]) % (1 << 64)] == r["component"]
    assert simhash.simhash_components(empty).count() == 0


def test_one_of_each_group_stays(spark, texts, odd, empty):
    long = texts(5, 300)
    near = long.split()
    near[150] = "changed"
    docs = spark.createDataFrame([(1, long), (2, " ".join(near)), (3, long), (4, texts(99, 300))], "doc_id long, text string")
    assert sorted(r[0] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()) == [1, 4]
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 1
    assert simhash.keep_one_of_each(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def jaccard(a, b):
    x, y = (set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_links_are_decided_by_the_similarity_of_shingles(spark):
    rng = random.Random(3)
    rows, near = [], {}
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = [*words[: rng.choice((225, 260, 272, 280))]]
        other += [f"v{rng.randrange(10**6)}" for _ in range(300 - len(other))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        near[2 * k + 1] = jaccard(rows[-2][1], rows[-1][1])
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert all(2 * k in kept for k in range(300))
    assert {i for i in near if near[i] < 0.8} <= kept
    close = [i for i in near if near[i] >= 0.8]
    assert len(close) > 100 and sum(i not in kept for i in close) >= 0.97 * len(close)


def test_large_candidate_groups_are_verified_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_NODES", 4)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([f"x{rng.randrange(10**6)}" if k and i == 10 * k else w for i, w in enumerate(words)])) for k in range(30)]
    docs = spark.createDataFrame([*rows, (100, "something else altogether in here")], "doc_id long, text string")
    assert sorted(r[0] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()) == [0, 100]


def test_keys_grow_with_the_table():
    for n in (100, 50_000, 250_000, 15_000_000, 10**10):
        bits, keys = simhash.key_plan(n, 0.8, 4)
        assert n / 2**bits <= 128 and keys < 500
    rng = np.random.default_rng(1)
    bits, keys = simhash.key_plan(250_000, 0.8, 4)
    share = float(np.arccos(2 * 0.8 / 1.8)) / np.pi
    picks = [np.random.default_rng(k).permutation(256)[:bits] for k in range(keys)]
    met = [any((~other[p]).all() for p in picks) for other in rng.random((2000, 256)) < share]
    assert np.mean(met) > 0.95


def test_rare_shingles_find_all_similar_pairs():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    template, sets = draw(200), []
    for k in range(120):
        base = sets[rng.integers(len(sets))] if sets and k % 3 == 0 else template[: rng.integers(0, 200)]
        sets.append(np.unique(np.concatenate([base, draw(rng.integers(0, 12 if k % 3 == 0 else 60))])))
    sets += [np.zeros(0, np.uint64), template[:1].copy(), template[:1].copy()]
    cells = np.arange(len(sets)) % 2
    cells[-2:] = 0
    met = set()
    for group in simhash.prefix_groups(cells, sets, 0.8):
        assert len(set(cells[group])) == 1
        met |= {(a, b) for a in group.tolist() for b in group.tolist() if a < b}
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if cells[a] == cells[b] and len(both := np.intersect1d(sets[a], sets[b])) and len(both) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))}
    assert len(similar) > 5 and similar <= met


def test_a_family_of_texts_under_the_similarity_is_verified_fast():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    template = draw(250)
    rows = [(1, 7, k, np.unique(np.concatenate([template, draw(100)])).tobytes(), 1, 2, 3, 4) for k in range(2000)]
    rows.append((1, 7, 2000, rows[5][3], 1, 2, 3, 4))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list("brnsabcd"))
    start = time.perf_counter()
    links = [tuple(r.values()) for out in simhash._verified(iter([batch]), 56, 0.8) for r in out.to_pylist()]
    # a loop over all pairs takes forty seconds and more
    assert links == [(5, 2000)] and time.perf_counter() - start < 20
