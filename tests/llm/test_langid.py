from collections import Counter

from millrace.llm import langid

EN = "the house and the garden were there when they thought about the weather and the others"
DE = "das haus und der garten waren schön als sie über das wetter und die anderen nachdachten"


def brute_grams(text):
    clean = " " + langid._NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            g = clean[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def test_grams_match_brute_force():
    for text in (EN, DE, "a", "a b", "x%%y 12 z"):
        keys, counts = langid.grams(text)
        plain = {}
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            parts = [k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF]
            plain["".join(chr(p) for p in parts if p)] = n
        assert plain == dict(brute_grams(text))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    whole = langid.grams(EN * 20)
    monkeypatch.setattr(langid, "PIECE", 37)
    parts = langid.grams(EN * 20)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_distance_is_out_of_place():
    profiles = langid.Profiles([("aa", 0, 97), ("aa", 1, 98), ("bb", 0, 98)], size=3)
    # text "b": grams " b", " b "?, "b" ... compared rank by rank
    own = langid.ranked(*langid.grams("b"), 400)
    best = {}
    for lang, known in (("aa", [97, 98]), ("bb", [98])):
        best[lang] = sum(abs(known.index(g) - r) if g in known else 3 for r, g in enumerate(own.tolist()))
    lang, score = profiles.judge("b")
    assert lang == min(best, key=best.get) and abs(score - (1 - min(best.values()) / (3 * len(own)))) < 1e-12


def test_identify(spark, odd, empty):
    train = spark.createDataFrame([(EN, "en"), (DE, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    profiles = langid.train_profiles(train)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(odd, profiles).collect()}
    assert got[3, None] == ("und", 0.0) and got[4, ""] == ("und", 0.0) and got[11, "12 %% 34"] == ("und", 0.0)
    assert all(0 <= s <= 1 and lang in ("en", "de", "und") for lang, s in got.values())
    assert langid.identify(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train_profiles(train.limit(0))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from millrace.llm.queries import op9_language_id

    rows = op9_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
