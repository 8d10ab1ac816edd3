"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``width`` consecutive words. The job is one plan over texts dealt out once by id:

1. *Candidates.* Each window names an anchor: the least hash of its four-word runs. A window that
   two texts share has one anchor in both, so only anchors that occur in several texts matter.
   Exact copies are set aside first: all words of a later copy are covered by the first one.
2. *Confirmed passages.* Windows of recurring anchors that start in two documents or more become
   patterns with their least id. An anchor with few stretches of text has them all in one task,
   which confirms their windows itself; the windows of frequent anchors are counted by window
   (with a map-side combine).
3. *Automata.* Patterns and the stretches of text around recurring anchors meet by anchor. Each
   task compiles automata of bounded size with pyahocorasick over word numbers and streams the
   stretches through them; every occurrence is located by its actual words. A frequent anchor's
   stretches are salted over many tasks, its patterns split in chunks.
4. Documents are joined with the located intervals, and covered words are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hash_words, shingle_hashes, texts_of

WIDTH = 13
#: Words of the runs whose least hash is a window's anchor.
ANCHOR = 4
#: Stretches of one anchor that one task streams; more are salted.
SALT = 5000
#: Stretches of one anchor for which its patterns are one chunk.
CHUNK = 50_000
#: Patterns in one automaton, and words of stretches that wait for it. A state's branches are
#: searched one by one, so many small automata are faster than a large one.
PATTERNS, WAITING = 400, 20_000
#: Words of stretches of infrequent anchors that wait for an automaton: about as many patterns.
CONFIRMING = 2000
#: Rows without an id stand after all others, by this and their text's hash: so they spread like ids.
UNNAMED = 1 << 62
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOW48 = np.uint64((1 << 48) - 1)


def windows(texts: list[str], width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all texts: text number, word position in it, window hash, anchor."""
    words, offsets = hash_words(texts)
    h, at = shingle_hashes(words, offsets, width)
    if not len(h):
        return at, at, h, h
    run = min(anchor, width)
    least = np.full(len(words), np.uint64(0xFFFFFFFFFFFFFFFF))
    g, where = shingle_hashes(words, offsets, run)
    least[where] = g & _LOW48
    # the least of width - run + 1 neighbours, by doubling; windows stay inside their text
    have, want = 1, width - run + 1
    while have < want:
        step = min(have, want - have)
        least[:-step] = np.minimum(least[:-step], least[step:])
        have += step
    least = least[at]
    text = np.searchsorted(offsets, at, side="right") - 1
    return text, at - offsets[text], h, least


def _batch(schema: str, *columns: np.ndarray | list) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, types[s.split()[1]]) for c, s in zip(columns, schema.split(", "), strict=True)], names=names)


_ANCHORS = "id long, anchor long, runs long"


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text, _, _, anchor = windows(texts_of(batch), width)
            if not len(text):
                continue
            # each anchor once a text, with its number of runs; neighbours mostly share theirs
            new = np.r_[True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])]
            text, anchor = text[new], anchor[new]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])
            yield _batch(_ANCHORS, batch.column(0).take(pa.array(text[new])), anchor[new].view(np.int64), np.diff(np.r_[new, len(text)]))

    return run


_STRETCHES = "id long, th long, anchor long, at int, words string"


def _stretches(width: int):
    """Runs of windows with one recurring anchor, as the words they span. The anchor's number of
    salts stands above its 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = texts_of(batch)
            text, at, _, anchor = windows(texts, width)
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            edges = np.searchsorted(text, np.arange(len(texts) + 1))
            out: list[tuple] = []
            for k, hits in enumerate(batch.column(3)):
                mine = slice(edges[k], edges[k + 1])
                a, p = anchor[mine].view(np.int64), at[mine]
                salted = np.array(hits.values, np.int64)
                salted = salted[np.argsort(salted & int(_LOW48))]
                known = salted & int(_LOW48)
                place = np.minimum(np.searchsorted(known, a), len(known) - 1)
                ok = np.flatnonzero(known[place] == a) if len(a) else np.zeros(0, np.int64)
                if not len(ok):
                    continue
                words = _WORDS.findall(texts[k])
                cuts = np.flatnonzero(np.r_[True, (a[ok[1:]] != a[ok[:-1]]) | (ok[1:] != ok[:-1] + 1)])
                for i, j in zip(cuts, np.r_[cuts[1:], len(ok)], strict=True):
                    first, last = int(p[ok[i]]), int(p[ok[j - 1]])
                    out.append((ids[k], ths[k], int(salted[place[ok[i]]]), first, " ".join(words[first : last + width])))
            if out:
                yield _batch(_STRETCHES, *[list(c) for c in zip(*out, strict=True)])

    return run


_WINDOWS = "id long, anchor long, window long"


def _stretch_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            words, offsets = hash_words(texts_of(batch, "words"))
            h, at = shingle_hashes(words, offsets, width)
            row = pa.array(np.searchsorted(offsets, at, side="right") - 1)
            yield _batch(_WINDOWS, *[batch.column(c).take(row) for c in (0, 2)], h.view(np.int64))

    return run


_FOUND = "id long, th long, at int, until int"


def is_frequent(anchor: int) -> bool:
    """Whether an anchor, with its number of salts above its 48 bits, has more stretches than one task streams."""
    return anchor >> 48 > 1


class _Shard:
    """Patterns and waiting stretches of some anchors; when full, one automaton for all of them."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.least: dict[tuple[int, int], int | None] = {}
        self.waiting: list[tuple] = []
        self.size = self.confirming = 0
        self.automaton = None
        self.numbers: dict[str, int] = {}

    def compile(self) -> None:
        """Numbers words, takes the confirmed windows' words from the waiting stretches."""
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.numbers = {}
        self.confirm([s for s in self.waiting if not is_frequent(s[2])])
        self.learn(self.waiting)

    def confirm(self, stretches: list[tuple]) -> None:
        """Finds the windows of infrequent anchors that start in several documents."""
        words, offsets = hash_words([s[4] for s in stretches])
        h, at = shingle_hashes(words, offsets, self.width)
        if not len(h):
            return
        row = np.searchsorted(offsets, at, side="right") - 1
        ids, anchors = np.array([s[0] for s in stretches], np.int64)[row], np.array([s[2] for s in stretches], np.int64)[row]
        order = np.lexsort((ids, h, anchors))
        ids, anchors, h = ids[order], anchors[order], h[order].view(np.int64)
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (anchors[1:] != anchors[:-1])])
        several = ids[starts] < ids[np.r_[starts[1:], len(ids)] - 1]
        starts = starts[several]
        self.least.update(zip(zip(anchors[starts].tolist(), h[starts].tolist(), strict=True), ids[starts].tolist(), strict=True))

    def learn(self, stretches: list[tuple]) -> None:
        """Adds the patterns that these stretches are the first to show."""
        words, offsets = hash_words([s[4] for s in stretches])
        h, at = shingle_hashes(words, offsets, self.width)
        rows = (np.searchsorted(offsets, at, side="right") - 1).tolist()
        split = [s[4].split(" ") for s in stretches]
        number, added = self.numbers, False
        for row, start, window in zip(rows, (at - offsets[rows]).tolist(), h.view(np.int64).tolist(), strict=True):
            least = self.least.pop((stretches[row][2], window), None)
            if least is not None:
                key = tuple([number.setdefault(w, len(number) + 1) for w in split[row][start : start + self.width]])
                self.automaton.add_word(key, least)
                added = True
        if added:
            self.automaton.make_automaton()

    def stream(self, stretches: list[tuple]) -> list[tuple]:
        """Occurrences (id, th, first word, word after) of patterns that begin in a smaller id."""
        out = []
        if not len(self.automaton):
            return out
        number, width = self.numbers.get, self.width
        for id_, th, _, at, text in stretches:
            first = until = -1
            for end, least in self.automaton.iter(tuple([number(w, 0) for w in text.split(" ")])):
                if least < id_:
                    start = end - width + 1
                    if start > until:
                        if until >= 0:
                            out.append((id_, th, at + first, at + until))
                        first = start
                    until = end + 1
            if until >= 0:
                out.append((id_, th, at + first, at + until))
        return out


def _locate(width: int):
    """Rows (anchor, part, id, th, at, words) in order of anchor and part: a part's patterns (even
    numbers, with least id and window hash as id and th) come before its stretches (odd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, cell = _Shard(width), None

        def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield _batch(_FOUND, *[list(c) for c in zip(*found, strict=True)])

        def flush() -> Iterator[pa.RecordBatch]:
            if shard.waiting:
                if shard.automaton is None:
                    shard.compile()
                else:
                    shard.learn(shard.waiting)
                yield from emit(shard.stream(shard.waiting))
                shard.waiting, shard.size = [], 0

        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True)
            for anchor, part, id_, th, at, words in rows:
                if (anchor, part >> 1) != cell:
                    # a cell ends: what has gathered is searched once it is enough
                    if shard.automaton is not None or len(shard.least) > PATTERNS or shard.size > WAITING or shard.confirming > CONFIRMING:
                        yield from flush()
                        shard = _Shard(width)
                    cell = anchor, part >> 1
                if not part & 1:
                    shard.least[anchor, th] = id_
                else:
                    shard.waiting.append((id_, th, anchor, at, words))
                    shard.size += words.count(" ") + 1
                    if not is_frequent(anchor):
                        shard.confirming += words.count(" ") + 1
                    elif shard.size > 2 * WAITING:  # a cell of many stretches is streamed in parts
                        yield from flush()
        yield from flush()

    return run


_KEPT = "id long, th long, n_words long, n_removed long, kept string"


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            total, removed, kept = [], [], []
            for text, copy, found in zip(texts_of(batch), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = _WORDS.findall(text)
                total.append(len(words))
                if copy and len(words) >= width:
                    words = []
                elif found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [f["at"] for f in found], 1)
                    np.add.at(gone, [f["until"] for f in found], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                removed.append(total[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "th", "n_words", "n_removed", "kept"])

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, th, n_words, n_removed, kept): every text without the words of windows that also start
    in a document with a smaller id; kept words are joined by one space.

    A null text has no words. Texts shorter than a window stay whole. Rows with one id do not
    cover each other. Null ids count as larger than any other (ids are below 2^62), ordered among
    themselves by text hash. Repeated rows give equal results, once each. An empty table gives
    none. Other columns are not read.
    """
    id_ = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))
    # One exchange of the texts serves all steps: each joins by id, and tells rows that share an id by th.
    texts = docs.select(id_.alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    same_text = lambda a, b: (a["id"] == b["id"]) & (a["th"].bitwiseXOR(b["th"]) == 0)
    # Later exact copies (same text, larger id): few columns, so grouped before the join.
    marks = docs.select(id_.alias("id"), F.xxhash64(text_col).alias("th"), F.hash(text_col).alias("th2"), F.length(text_col).alias("size"))
    same = ["th", "th2", "size"]
    firsts = marks.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(*same, "first")
    copies = marks.join(firsts, same).where("id > first").select("id", "th").distinct().withColumn("copy", F.lit(True))
    sources = texts.join(copies, same_text(texts, copies), "left_anti")

    anchors = sources.mapInArrow(_anchors(width), _ANCHORS)
    recurring = anchors.groupBy("anchor").agg(F.count("*").alias("texts"), F.sum("runs").alias("n")).where("texts > 1").select("anchor", "n")
    salted = F.shiftleft(F.least(F.ceil(F.col("n") / SALT), F.lit(0x7FFF)).cast("long"), 48).bitwiseOR(F.col("anchor"))
    hits = anchors.select("id", "anchor").join(recurring, "anchor").groupBy("id").agg(F.collect_list(salted).alias("hits"))
    stretches_of = lambda hits: sources.join(hits, "id").select("id", "th", "text", "hits").mapInArrow(_stretches(width), _STRETCHES)
    stretches = stretches_of(hits)
    frequent = stretches_of(hits.withColumn("hits", F.filter("hits", lambda a: F.shiftright(a, 48) > 1)).where(F.size("hits") > 0))

    salts = F.shiftright("anchor", 48).cast("int")
    chunks = F.ceil(salts * SALT / CHUNK).cast("int")
    part = lambda kind: ((F.col("chunk") * (1 << 16) + F.col("salt")) * 2 + kind).cast("int").alias("part")
    to = lambda last: F.explode(F.sequence(F.lit(0), last - 1))
    confirmed = frequent.mapInArrow(_stretch_windows(width), _WINDOWS).groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    patterns = confirmed.withColumn("chunk", F.pmod("window", chunks)).withColumn("salt", to(salts))
    patterns = patterns.select("anchor", part(0), F.col("least").alias("id"), F.col("window").alias("th"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("words"))
    routed = stretches.withColumn("salt", F.pmod(F.xxhash64("id", "at"), salts)).withColumn("chunk", to(chunks))
    routed = routed.select("anchor", part(1), "id", "th", "at", "words")
    shards = patterns.union(routed).repartition("anchor", F.shiftright("part", 1)).sortWithinPartitions("anchor", "part")
    found = shards.mapInArrow(_locate(width), _FOUND).groupBy("id", "th").agg(F.collect_list(F.struct("at", "until")).alias("found"))

    whole = texts.join(copies, same_text(texts, copies), "left").select(texts["id"], texts["th"], "text", "copy")
    whole = whole.join(found, same_text(whole, found), "left").select(whole["id"], whole["th"], "text", "copy", "found")
    kept = whole.mapInArrow(_remove(width), _KEPT)
    return kept.withColumn("id", F.when(F.col("id") < UNNAMED, F.col("id")))
