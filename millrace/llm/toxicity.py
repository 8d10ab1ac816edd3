"""Toxic passages by maximum-scoring segments over token log-odds.

1. Words of labelled texts are counted by label, each once a text (a word that one text repeats
   often says little). A word is a candidate if the signed root of the likelihood ratio for it
   against equal shares is at least ``Z`` (unlike a normal bound it holds for counts of zero).
   Candidates are counted over all documents: that distribution, as strong as ``PRIOR`` times the
   labelled words, is the Dirichlet prior of their log-odds, so a word that is common in the corpus
   needs more evidence than a rare one. Candidates with log-odds of at least ``ODDS`` are the
   model's terms; all other words together are one further outcome.
2. A word scores the log of its probability in toxic over that in clean texts, so a text's
   expected score is negative unless it is toxic. A linear-time scan (Ruzzo and Tompa) finds all
   maximal scoring segments.
3. With log-likelihood ratios a segment's score S has the extreme-value tail K n exp(-S) in a clean
   text of n words. K is fitted on clean texts; segments with an expected count of at most
   ``EXPECTED`` are the significant passages.
4. The best segments' evidence, log sum exp(S) - log(K n), is mapped to a probability by a logistic
   curve in its asinh (long texts have evidence in the hundreds), fitted on the labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, hash_words, texts_of

#: Labelled rows that are fitted on, those with the smallest id hash: bounds what is broadcast.
FIT_ROWS = 200_000
#: Candidate terms, those with the largest z: bounds what the driver and the tasks hold (16 bytes each).
TERMS = 1 << 20
PRIOR, Z = 0.02, 3.5
#: Least log-odds of a term: words that only go with the language of toxic texts stay below.
ODDS = 1.5
EXPECTED = 0.05
#: Distinct words that a counting task holds before it hands them on.
HELD = 1 << 20
_BIN = 0.25
_PART = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@dataclass
class Model:
    """Terms as sorted word hashes with their scores, the score of all other words, and the calibration."""

    terms: np.ndarray
    scores: np.ndarray
    other: float
    k: float = 1.0
    intercept: float = -3.0
    slope: float = 1.0


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([t.lower() for t in texts], _PART)


def maximal_segments(places: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after, score) of a sequence whose words at
    ``places`` have these positive scores while all others score ``other`` (at most 0).

    Every kept segment knows the nearest earlier one with a smaller sum before it. A search follows
    these links, and what it has passed is never passed again, so the scan is linear.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, after, running sum before, at the end, link
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += other * (place - at)
        first, low = place, total
        total += score
        at = place + 1
        link = len(kept) - 1
        while link >= 0 and kept[link][2] >= low:
            link = kept[link][4]
        while link >= 0 and kept[link][3] < total:
            # extend to the left: everything from the link on becomes one segment
            first, _, low, _, before = kept[link]
            del kept[link:]
            link = before
        kept.append((first, at, low, total, link))
    return [(k[0], k[1], k[3] - k[2]) for k in kept]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of (text, toxic) rows with their numbers of texts by label."""
    held: list[np.ndarray] = []
    size = 0

    def merged() -> np.ndarray:
        rows = np.concatenate(held)
        keys, where = np.unique(rows["h"], return_inverse=True)
        out = np.zeros(len(keys), rows.dtype)
        out["h"] = keys
        for c in ("dt", "dc"):
            out[c] = np.bincount(where, weights=rows[c], minlength=len(keys)).astype(np.int64)
        return out

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["h"].view(np.int64)), *[pa.array(rows[c]) for c in ("dt", "dc")]], names=["h", "dt", "dc"])

    kind = np.dtype([("h", "u8"), ("dt", "i8"), ("dc", "i8")])
    for batch in blocks(batches):
        words, offsets = words_of(texts_of(batch))
        toxic = np.asarray(batch.column(1).to_pylist(), np.int64)
        text = np.repeat(np.arange(len(toxic)), np.diff(offsets))
        order = np.lexsort((words, text))
        words, text = words[order], text[order]
        starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (text[1:] != text[:-1])]) if len(words) else np.zeros(0, int)
        label = toxic[text[starts]]
        rows = np.zeros(len(starts), kind)
        rows["h"], rows["dt"], rows["dc"] = words[starts], label, 1 - label
        held.append(rows)
        size += len(rows)
        if size > HELD:
            held = [merged()]
            size = len(held[0])
            if size > HELD // 2:
                yield batch_of(held[0])
                held, size = [], 0
    if held:
        yield batch_of(merged())


def _frequencies(candidates: np.ndarray):
    """In how many texts each of the (sorted) candidates is; null stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(candidates), np.int64), 0
        for batch in blocks(batches):
            words, offsets = words_of(texts_of(batch))
            text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = np.minimum(np.searchsorted(candidates, words), len(candidates) - 1)
            hit = np.flatnonzero(candidates[place] == words)
            once = np.unique(np.stack([text[hit], place[hit]], axis=1), axis=0)
            n += np.bincount(once[:, 1], minlength=len(candidates))
            order = np.lexsort((words, text))
            words, text = words[order], text[order]
            total += int(len(words) and 1 + ((words[1:] != words[:-1]) | (text[1:] != text[:-1])).sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*candidates[some].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[some].tolist(), total], pa.int64())], names=["h", "n"])

    return run


def fit_terms(labelled: DataFrame, corpus: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """The terms of the model, learned from labelled texts with the words of ``corpus`` as prior;
    without texts of both labels there are none."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    counts = rows.mapInArrow(_count, "h long, dt long, dc long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("dt", "dc")])
    counts = cut(counts, "toxic-counts")
    n_t, n_c = counts.agg(F.sum("dt"), F.sum("dc")).first()
    if not n_t or not n_c:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    part = lambda y, n: F.when(y > 0, y * F.log(y / ((F.col("dt") + F.col("dc")) * F.lit(float(n)) / F.lit(float(n_t + n_c))))).otherwise(0.0)
    z = F.sqrt(F.greatest(2 * (part(F.col("dt"), n_t) + part(F.col("dc"), n_c)), F.lit(0.0)))
    more = F.col("dt") * F.lit(float(n_c)) > F.col("dc") * F.lit(float(n_t))
    got = counts.withColumn("z", z).where(more & (F.col("z") >= Z)).orderBy(F.desc("z"), "h").limit(TERMS).select("h", "dt", "dc").collect()
    if not got:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    h = np.array([r[0] for r in got], np.int64).view(np.uint64)
    order = np.argsort(h)
    h, dt, dc = h[order], *(np.array([r[k] for r in got], float)[order] for k in (1, 2))
    seen = dict(corpus.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_frequencies(h), "h long, n long").groupBy("h").agg(F.sum("n")).collect())
    strength = PRIOR * (n_t + n_c)
    alpha = strength * np.array([seen.get(k, 0) for k in h.view(np.int64).tolist()], float) / max(1, seen.get(None, 0))
    p_t, p_c = (dt + alpha) / (n_t + strength), (dc + alpha) / (n_c + strength)
    # A word that no document has (labels of another corpus) has no prior and no evidence of clean texts.
    score = np.log(p_t / np.maximum(p_c, 1e-300))
    use = (score >= ODDS) & (alpha > 0)
    h, score, p_t, p_c = h[use], score[use], p_t[use], p_c[use]
    if not len(h):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    other = math.log(max(1e-9, 1 - p_t.sum()) / max(1e-9, 1 - p_c.sum()))
    return Model(h, score, min(other, -1e-6))


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words, offsets = words_of(texts_of(batch))
            place = np.minimum(np.searchsorted(model.terms, words), max(0, len(model.terms) - 1))
            hits = np.flatnonzero(model.terms[place] == words) if len(model.terms) else np.zeros(0, np.int64)
            edges = np.searchsorted(hits, offsets)
            evidence, segments = [], []
            for k in range(batch.num_rows):
                mine = hits[edges[k] : edges[k + 1]]
                found = maximal_segments((mine - offsets[k]).tolist(), model.scores[place[mine]].tolist(), model.other) if len(mine) else []
                top = max([f[2] for f in found], default=0.0)
                evidence.append(top + math.log(sum(math.exp(f[2] - top) for f in found) if found else 1.0))
                segments.append([{"start": a, "until": b, "score": s} for a, b, s in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(evidence, pa.float64()), pa.array(segments, kind)], names=["id", "n_words", "evidence", "segments"])

    return run


def calibrate(model: Model, bins: list[tuple[int, float, int]]) -> None:
    """Fits K on clean and the logistic curve on all (label, evidence - log n, number) bins."""
    clean = sorted((x, n) for label, x, n in bins if label == 0)
    total = sum(n for _, n in clean)
    if total:
        # the Gumbel law's 95% point: exp(-K exp(-t)) = 0.95
        seen = 0
        for t, n in clean:
            seen += n
            if seen >= 0.95 * total:
                model.k = max(1e-12, -math.log(0.95) * math.exp(t))
                break
    y = np.array([b[0] for b in bins], float)
    x = np.array([b[1] for b in bins]) - math.log(model.k)
    w = np.array([b[2] for b in bins], float)
    if not len(bins) or not 0 < (w * y).sum() < w.sum():
        return
    features = np.stack([np.ones_like(x), np.arcsinh(x)], axis=1)
    ridge = np.diag([1e-3, 1e-2])
    loss = lambda b: (w * np.logaddexp(0, (1 - 2 * y) * (features @ b))).sum() + b @ ridge @ b / 2
    beta = np.array([-3.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve((features * (w * p * (1 - p))[:, None]).T @ features + ridge, gradient)
        now = loss(beta)
        while np.abs(step).max() > 1e-9 and loss(beta + step) > now:  # the loss is convex: halving ends
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.intercept, model.slope = float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, score, predicted, n_words, passages), a row for each row of ``docs``; passages are the
    significant segments (start, until in words, score, expected number in a clean text).

    ``labels`` (id, label) names the rows to learn from, the ``fit_rows`` with the smallest id
    hashes; of several labels for an id the largest counts; other values than 0 and 1 do not.
    Nothing but texts and those labels is read. A null or empty text has no words and gets the
    score of no evidence; repeated rows score alike. Empty tables give no rows; without labels of
    both kinds all scores are the prior's. Ties in the model's terms go by hash.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__toxic")).where("__id is not null and __toxic in (0, 1)")
    known = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    known = cut(known, "toxic-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # at most fit_rows rows of two numbers
    labelled = rows.join(F.broadcast(known), rows["id"] == known["__id"])
    model = fit_terms(labelled, rows, "text", "__toxic")
    scanned = rows.mapInArrow(_scan(model), "id long, n_words long, evidence double, segments array<struct<start:long,until:long,score:double>>")
    scanned = cut(scanned, "toxic-segments")
    log_n = F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    x = F.floor((F.col("evidence") - log_n) / _BIN)
    bins = scanned.join(F.broadcast(known), scanned["id"] == known["__id"]).groupBy("__toxic", x.alias("bin")).agg(F.count("*").alias("n")).collect()
    calibrate(model, [(r[0], (r[1] + 0.5) * _BIN, r[2]) for r in bins])
    normal = F.col("evidence") - log_n - math.log(model.k)
    score = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.asinh(normal))))
    expected = lambda s: F.lit(model.k) * F.col("n_words") * F.exp(-s["score"])
    passages = F.filter(F.transform("segments", lambda s: F.struct(s["start"], s["until"], s["score"], expected(s).alias("expected"))), lambda s: s["expected"] <= EXPECTED)
    return scanned.select("id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_words", passages.alias("passages"))
