"""Language identification by rank-order profiles (out-of-place distance).

A language's profile is the list of its most frequent letter n-grams (one to three letters, word
ends marked) over all training texts. A document's own most frequent n-grams are ranked the same
way; its distance to a language is the sum of the rank differences, where an n-gram that the
profile lacks counts as the profile's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh

#: N-grams in a profile, and n-grams of a document that are compared with it.
PROFILE = 400
DOCUMENT = 400
UNDETERMINED = "und"
#: Letters that are counted at once; longer texts are counted piece by piece.
PIECE = 1 << 19
#: Distinct n-grams per language that a training task holds before it hands them on.
HELD = 1 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (three code points packed into an integer) and their counts."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    clean = _NOT_LETTERS.sub(" ", text.lower())
    codes = np.frombuffer(f" {clean.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(codes) <= 2 or not clean.isascii() and not any(c.isalpha() for c in clean):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for at in range(0, len(codes), PIECE):
        c = codes[at : at + PIECE + 2]
        own = min(PIECE, len(codes) - at)
        one = c[:own]
        two = (c[: len(c) - 1][:own] << 21) | c[1:][:own]
        three = (c[: len(c) - 2][:own] << 42) | (c[1 : len(c) - 1][:own] << 21) | c[2:][:own]
        middle = c[1 : len(c) - 1][:own]  # a word end may be at either side but not inside
        parts.append(np.unique(np.concatenate([one[one != 32], two, three[middle != 32]]), return_counts=True))
    return parts[0] if len(parts) == 1 else _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, most frequent first, ties by n-gram."""
    return keys[np.lexsort((keys, -counts))[:most]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, counts = _merged(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in blocks(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = grams(text)
            if len(got[0]):
                held.setdefault(lang, []).append(got)
        for lang in list(held):
            if sum(len(k) for k, _ in held[lang]) > HELD:
                held[lang] = [_merged(held[lang])]
                if len(held[lang][0][0]) > HELD // 2:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def train_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the profile of every language of the labelled rows, rank from 0.

    Counts cover every row whose language and text aren't null. Texts without letters add nothing.
    """
    from pyspark.sql import Window

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "rank", "gram")


class Profiles:
    """Profiles as arrays: bounded by the number of languages times the profile's size."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE) -> None:
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.keys = np.unique(np.array([r[2] for r in rows], np.int64))
        # place[l, k]: the rank of n-gram k in language l; -1 if it isn't in the profile
        self.place = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for lang, rank, gram in rows:
            self.place[self.langs.index(lang), np.searchsorted(self.keys, gram)] = rank

    def judge(self, text: str | None, most: int = DOCUMENT) -> tuple[str, float]:
        """The language with the least out-of-place distance, ties by name, and 1 minus that
        distance over the greatest possible one."""
        if not self.langs:
            return UNDETERMINED, 0.0
        own = ranked(*grams(text), most)
        if not len(own):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        at = np.where(self.keys[at] == own, at, len(self.keys))
        place = self.place[:, at]
        apart = np.where(place < 0, self.size, np.minimum(np.abs(place - np.arange(len(own))), self.size)).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", size: int = PROFILE) -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) as two columns more.

    ``und`` and score 0 where the text is null or has no letter, or where there is no profile. All
    rows and other columns stay as they are, columns of the two names are replaced; ties go to the first language by name. Only the
    profiles (languages times ``size`` rows) pass through the driver.
    """
    known = Profiles([tuple(r) for r in profiles.select("lang", "rank", "gram").collect()], size)

    (own,) = fresh(docs, "judged")
    kept = docs.withColumn(own, judged_column(known, F.col(text_col)))
    return kept.withColumns({lang_name: F.col(f"{own}.lang"), score_name: F.col(f"{own}.score")}).drop(own)


def judged_column(known: Profiles, text: Column) -> Column:

    def judge(texts: pd.Series) -> pd.DataFrame:
        got = [known.judge(t) for t in texts]
        return pd.DataFrame({"lang": pd.Series([g[0] for g in got], dtype="object"), "score": pd.Series([g[1] for g in got], dtype="float64")})

    return F.pandas_udf(judge, "lang string, score double")(text)
