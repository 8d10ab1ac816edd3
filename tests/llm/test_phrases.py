import re

import xxhash

from millrace.llm import phrases


def place(i, t):
    """Where a row stands: by id; rows without an id after all others, by their text's hash."""
    return i if i is not None else phrases.UNNAMED | (xxhash.xxh64_intdigest((t or "").encode(), 42) & (phrases.UNNAMED - 1))


def brute(rows, width):
    """(id, kept words, n) of (id, text) rows, straight from the definition."""
    words = [(i, place(i, t), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for _, p, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, p), p)
    out = []
    for i, p, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < p:
                gone.update(range(k, k + width))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w)))
    return sorted(out, key=str)


def run(df, width):
    return sorted(((r["id"], r["kept"], r["n_words"]) for r in phrases.drop_repeated_passages(df, width=width).collect()), key=str)


def test_matches_the_definition(spark, texts):
    shared, line = texts(50, 70), "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(k, f"{texts(k, 30)} {shared if k % 3 == 0 else ''} {texts(k + 100, 20)} {line if k % 2 else ''}") for k in range(40)]
    rows += [(50, rows[3][1]), (51, shared), (52, " ".join(shared.split()[5:30])), (53, "a " * 40), (54, "b " * 3 + "a " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 13) == brute(rows, 13)
    assert run(df, 5) == brute(rows, 5)


def test_frequent_anchors_are_salted_and_chunked(spark, texts, monkeypatch):
    monkeypatch.setattr(phrases, "SALT", 3)
    monkeypatch.setattr(phrases, "CHUNK", 6)
    monkeypatch.setattr(phrases, "PATTERNS", 4)
    monkeypatch.setattr(phrases, "WAITING", 50)
    shared = texts(50, 40)
    rows = [(k, f"{texts(k, 10)} {shared} {texts(k + 100, 10)}") for k in range(30)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 13) == brute(rows, 13)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd, 13) == brute(rows, 13)
    assert phrases.drop_repeated_passages(empty).count() == 0


def test_rows_without_id_spread(spark, texts):
    shared = texts(50, 40)
    rows = [(None, f"{texts(k, 10)} {shared if k % 2 else ''}") for k in range(60)] + [(None, texts(1, 30))] * 3 + [(None, None)] * 20 + [(3, shared)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 13) == brute(rows, 13)
