"""Benchmark decontamination with spaced seeds.

Benchmark and documents are read as lower-case words. Fixed masks over eight consecutive words
keep five positions and ignore the others; equal hashes of the kept words are hits. Each hit puts
a benchmark item on a diagonal of a document, where words are compared one by one: an overlap is
every window of 13 words (all of an item that has 8 to 12) of which at least 80% agree. Items of
fewer words are hit by a mask over all of them and must agree in every word.

The three masks hit every such window: test cases enumerate all ways to replace up to two of 13
(11, 10) words, one of 9 or 8. So a verified overlap is never lost to the seeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, hash_words, keyed, mix, texts_of

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
WINDOW = 13
#: Items with fewer words can't be told from chance: they are searched exactly, and do not remove documents.
LEAST_WORDS = 8
#: Pairs of equal seeds that are looked at together.
PAIRS = 1 << 22
SIMILARITY = 0.8
#: Bytes of benchmark text that are sent to the tasks at once; more are searched in further blocks.
BLOCK = 32 << 20
#: Bytes below this value that aren't letters or digits part words.
_PART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TOKENS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BITS = 20

_OUT = "id long, th long, item_id long, start long, until long, n_match long, item_words long, passage string"


def tokens(text: str | None) -> list[str]:
    return _TOKENS.findall((text or "").lower())


def need(n: int, similarity: float = SIMILARITY) -> int:
    """Words that must agree in a window of ``n``."""
    return n if n < LEAST_WORDS else int(np.ceil(similarity * n - 1e-9))


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The masked hash at every position whose span fits (a span may cross texts; verification
    tells)."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for o in mask:
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[o : o + n]
    return mix(h)


class Index:
    """Seed hashes of one block of benchmark items, bounded by ``BLOCK``."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = [i for i in items if tokens(i[1])]
        self.ids = [i[0] for i in items]
        self.words, self.offsets = hash_words([(i[1] or "").lower() for i in items], _PART)
        sizes = np.diff(self.offsets)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.seeds = []
        short = [(tuple(range(n)), self.offsets[:-1][sizes == n]) for n in np.unique(sizes[sizes < LEAST_WORDS]).tolist()]
        for mask, only in [*((m, None) for m in MASKS), *short]:
            h = seeds(self.words, mask)
            own = np.flatnonzero(sizes[self.item[: len(h)]] >= LEAST_WORDS) if only is None else only
            order = own[np.argsort(h[own], kind="stable")]
            filled = np.zeros(1 << _BITS, bool)
            filled[h[order] >> np.uint64(64 - _BITS)] = True
            self.seeds.append((mask, h, h[order], order, filled))

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in words, position in the benchmark) whose masked hashes are equal, of each
        run along a diagonal the first one."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begins = np.repeat(offsets[:-1], np.diff(offsets))
        for mask, theirs, known, order, filled in self.seeds:
            h = seeds(words, mask)
            at = np.flatnonzero(filled[h >> np.uint64(64 - _BITS)])
            low = np.searchsorted(known, h[at], "left")
            n = np.searchsorted(known, h[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            parts = np.cumsum(n) // PAIRS
            for part in np.unique(parts):
                a, l, m = at[parts == part], low[parts == part], n[parts == part]
                own, other = np.repeat(a, m), order[np.repeat(l, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                inside = (own > begins[own]) & (other > self.offsets[self.item[other]])
                new = ~inside | (h[own - 1] != theirs[other - 1])
                found.append((own[new], other[new]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def overlaps(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Verified overlaps as (text, item, first word, word after, words that agree), one for
        each text and item: that with most agreeing words, the earliest of them."""
        at, there = self.hits(words, offsets)
        if not len(at):
            return []
        text = np.searchsorted(offsets, at, side="right") - 1
        item = np.searchsorted(self.offsets, there, side="right") - 1
        lines = np.unique(np.stack([text, item, (at - offsets[text]) - (there - self.offsets[item])], axis=1), axis=0)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, shift in lines.tolist():
            own, other = words[offsets[t] : offsets[t + 1]], self.words[self.offsets[i] : self.offsets[i + 1]]
            for first, until, n in aligned(own, other, shift):
                old = best.get((t, i))
                if old is None or (n, -first) > (old[2], -old[0]):
                    best[t, i] = first, until, n
        return [(t, i, *x) for (t, i), x in sorted(best.items())]


def aligned(own: np.ndarray, other: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs of good windows when word j of ``other`` lies on word j + shift of ``own``."""
    low, high = max(0, shift), min(len(own), shift + len(other))
    window = min(WINDOW, len(other))
    if high - low < window:
        return []
    same = own[low:high] == other[low - shift : high - shift]
    sums = np.r_[0, np.cumsum(same)]
    good = np.flatnonzero(sums[window:] - sums[:-window] >= need(window))
    if not len(good):
        return []
    cuts = np.flatnonzero(np.r_[True, good[1:] > good[:-1] + window])
    out = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(good)], strict=True):
        first, until = int(good[a]), int(good[b - 1]) + window
        out.append((low + first, low + until, int(sums[until] - sums[first])))
    return out


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = texts_of(batch)
            words, offsets = hash_words([t.lower() for t in texts], _PART)
            found = index.overlaps(words, offsets)
            if found:
                rows = pa.array([f[0] for f in found])
                passages = [" ".join(tokens(texts[t])[a:b]) for t, _, a, b, _ in found]
                sizes = np.diff(index.offsets)
                columns = [pa.array([index.ids[f[1]] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)], pa.array([int(sizes[f[1]]) for f in found], pa.int64()), pa.array(passages, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, th, item_id, start, until, n_match, item_words, passage): for every document and benchmark item that
    share an overlap, the largest one, as word positions of the document and as words.

    The benchmark is the query set: it is measured first and searched in blocks of at most
    ``block`` bytes of text (a single longer item is a block of its own), each against all
    documents, so what a task holds stays bounded. Null texts have no words; items under
    ``LEAST_WORDS`` words must occur word by word; repeated rows are each searched; an empty table on
    either side gives no rows. Other columns are not read.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block)) if size > block else 1
    rows = keyed(docs, id_col, text_col)
    parts = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        parts.append(rows.mapInArrow(_scan(Index(sorted([(r[0], r[1]) for r in part], key=lambda r: (r[0] is None, r[0] or 0, r[1])))), _OUT))
    return reduce(DataFrame.union, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the documents that overlap with a benchmark item of ``least_words`` words or
    more; all other rows and all columns stay as they are."""
    own_id, own_th = fresh(docs, "overlap_id", "overlap_th")
    bad = benchmark_overlaps(docs, benchmark, id_col, text_col).where(F.col("item_words") >= least_words).select(F.col("id").alias(own_id), F.col("th").alias(own_th)).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text_col)) == F.col(own_th)), "left_anti")
