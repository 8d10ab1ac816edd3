import pytest

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us".split()


def text(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 127] + (chr(97 + (x >> 16) % 26) * ((x >> 20) % 3)))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    return text


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an id with two texts, and columns named like operators' own."""
    rows = [
        (1, text(1, 60), "en", "a"), (2, text(1, 60), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "fr", "b"),
        (6, text(6, 5000), "en", "c"), (7, text(7, 40), None, "a"), (7, text(7, 40), None, "a"), (8, text(8, 30), "en", None), (8, text(9, 30), "en", "c"),
        (None, text(10, 50), "en", "a"), (None, None, None, None), (11, "12 %% 34", "de", "c"), (12, "x" * 3000, "de", "c"), (13, "été über ñandú " * 20, "fr", "b"),
    ]
    rows = [(*r, len(r[1] or ""), "id", 1, "th", "fp", "cell", "size", "judged", 0.5, "xx", 7, 8, "node") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, th int, bucket string, fp string, cell string, size string, judged string, score double, lang_pred string, kept_id int, mix_at int, node string").coalesce(2)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
