"""Near-duplicates by SimHash, with bit-sliced comparison of fingerprints.

1. Every text gets a 64-bit fingerprint: the bitwise majority of the XXH64 hashes of its shingles.
2. Distinct fingerprints meet where they agree on two of six bit blocks. Two fingerprints within
   four bits disagree in four blocks at most, so every such pair meets in one table at least.
3. A meeting place (cell) is compared bit-sliced: its fingerprints are stored as vertical bit
   planes, a carry-save counter adds one plane to 64 distances at once, and a row is abandoned as
   soon as all 64 are beyond the radius. Cells larger than ``CELL`` are split into sub-cells for
   all pairs of their parts, so no task holds an unbounded group and no pair is lost.
4. A cell yields one link from each fingerprint to its group's first one, never all pairs;
   components are found over these links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, fresh, keyed, mix, texts_of
from .components import connected_components

#: Largest number of fingerprints in one cell; more are split.
CELL = 4096
#: Rows that the comparison handles at once.
ROWS = 1 << 17
#: Hot keys that are broadcast.
FEW = 1 << 16
#: Unlike fingerprints that meet in a cell, and the share of pairs at the similarity that meet at all.
MET, RECALL = 128, 0.98
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The integer whose bits are set in over half of the hashes (0 for none).

    Bits are counted eight at a time in the bytes of 64-bit words, in runs of at most 255 hashes.
    """
    n = len(hashes)
    if not n:
        return 0
    runs = -(-n // 255)
    padded = np.zeros(runs * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(runs, 255)
    out = 0
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(runs, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + bit)
    return out


def shingle_digests(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles, repeats included; a shorter text is one shingle."""
    words = _WORDS.findall((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    data = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.cumsum([len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words]) + np.arange(len(words))
    n = max(1, len(words) - shingle + 1)
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text: lower-case A-Z, words, shingles with repeats, XXH64 seed 42."""
    return majority(shingle_digests(text, shingle))


def long_fingerprint(text: str | None, shingle: int, words: int) -> list[int]:
    """``words`` times 64 bits: the first is the fingerprint, the others use the hashes mixed anew."""
    digests = shingle_digests(text, shingle)
    return [majority(mix(digests ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if k else digests) for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """(id, th, f0, f1, ...) of a keyed table, with fingerprint words as signed longs."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fps = np.array([long_fingerprint(t, shingle, words) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(fps[:, k]) for k in range(words)]], names=["id", "th", *names])

    return docs.mapInArrow(run, "id long, th long, " + ", ".join(f"{n} long" for n in names))


def _pieces(blocks_: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, 64, blocks_ + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def band_keys(fp: Column, radius: int = 4, agree: int = 2) -> Column:
    """The keys under which a fingerprint is filed: with radius + agree blocks, two fingerprints
    within the radius agree on ``agree`` blocks at least, and so share a key."""
    pieces = _pieces(radius + agree)
    keys = []
    for t, chosen in enumerate(combinations(pieces, agree)):
        key = F.lit(t).cast("long")
        for a, b in chosen:
            key = F.shiftleft(key, b - a).bitwiseOR(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        keys.append(key)
    return F.array(*keys)


def key_plan(n: int, similarity: float, words: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of keys) for ``n`` fingerprints: as many bits as leave about ``MET``
    unlike fingerprints to a cell whatever ``n`` is, and as many keys as make a pair at the
    similarity share one with probability ``recall``."""
    bits = min(64 * words // 2, max(8, (max(2, n) - 1).bit_length() - (MET - 1).bit_length()))
    agree = (1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))


def filed_by_keys(distinct: DataFrame, names: list[str], bits: int, keys: int) -> DataFrame:
    """(key, node, fingerprint words): each fingerprint under its keys, which are fixed selections of its bits."""
    rng = np.random.default_rng(42)
    chosen = np.stack([rng.permutation(64 * len(names))[:bits] for _ in range(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = np.stack([c.to_numpy() for c in part.columns[1:]], axis=1).view(np.uint8)
                planes = np.unpackbits(fps, axis=1, bitorder="little")
                for t, places in enumerate(chosen):
                    # a key is a hash of its bits and its number, so that keys of any width fit
                    packed = np.packbits(planes[:, places], axis=1, bitorder="little")
                    key = np.full(len(packed), t + 1, np.uint64)
                    for k in range(packed.shape[1]):
                        key = mix(key * np.uint64(257) + packed[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *part.columns], names=["key", "node", *names])

    return distinct.select("node", *names).mapInArrow(run, "key long, node long, " + ", ".join(f"{n} long" for n in names))


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where a vertical counter is more than ``radius``."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more = more | (same & counter[k])
            same = same & ~counter[k]
    return more


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; every root stays the smallest index of its set."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])


def bit_sliced_groups(cells: np.ndarray, fps: np.ndarray, radius: int = 4) -> np.ndarray:
    """For rows sorted by cell: the index of the first row with which each row is linked, directly or
    through others, inside its cell. Rows (of one or more 64-bit words) link where they differ in
    ``radius`` bits at most."""
    parent = np.arange(len(fps))
    for a, b in bit_sliced_pairs(cells, fps, radius):
        _union(parent, a, b)
    return parent


def bit_sliced_pairs(cells: np.ndarray, fps: np.ndarray, radius: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by cell: the indices of all pairs of a cell that differ in ``radius`` bits at
    most, some at a time; ``_union`` over them gives the groups."""
    n = len(fps)
    fps = fps.reshape(n, -1)
    bits = 64 * fps.shape[1]
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    words = -(-n // 64)
    padded = np.zeros((words * 64, fps.shape[1]), np.uint64)
    padded[:n] = fps
    planes = [np.packbits((padded[:, b // 64] >> np.uint64(b % 64)).astype(np.uint8) & 1, bitorder="little").view(np.uint64) for b in range(bits)]
    width = (radius + 1).bit_length()
    rows = np.arange(n)
    offset = 0
    while True:
        word = rows // 64 + offset
        rows = rows[ends[rows] > np.maximum(word * 64, rows + 1)]
        if not len(rows):
            return
        word = rows // 64 + offset
        low = np.maximum(rows + 1 - word * 64, 0).astype(np.uint64)
        high = np.minimum(ends[rows] - word * 64, 64).astype(np.uint64)
        wanted = (_ONES << np.minimum(low, np.uint64(63))) & (_ONES >> (np.uint64(64) - high))
        wanted[low > 63] = 0
        over, left, fp = ~wanted, rows, fps[rows]
        counter = [np.zeros(len(left), np.uint64) for _ in range(width)]
        for b in range(bits):
            add = planes[b][word] ^ (np.uint64(0) - ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
            for k in range(width):
                counter[k], add = counter[k] ^ add, counter[k] & add
            over = over | add
            if b % 8 == 7:
                over = over | _over(counter, radius)
                alive = over != _ONES
                if not alive.all():
                    left, word, fp, over = left[alive], word[alive], fp[alive], over[alive]
                    counter = [c[alive] for c in counter]
                    if not len(left):
                        break
        for at in range(0, len(left), 1 << 14):
            part = slice(at, at + (1 << 14))
            row, col = np.nonzero(np.unpackbits((~over[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield left[part][row], word[part][row] * 64 + col
        offset += 1


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, node, fingerprint words) sorted by cell; holds one cell and ``ROWS`` rows at most."""
    held: list[np.ndarray] = []
    size = 0

    def done(rows: np.ndarray) -> pa.RecordBatch:
        first = bit_sliced_groups(rows[:, 0], rows[:, 2:].view(np.uint64), radius)
        moved = first != np.arange(len(rows))
        return pa.RecordBatch.from_arrays([pa.array(rows[moved, 1]), pa.array(rows[first[moved], 1])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        size += batch.num_rows
        if size >= ROWS:
            rows = np.concatenate(held)
            upto = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if upto:
                yield done(np.ascontiguousarray(rows[:upto]))
            held, size = [rows[upto:]], len(rows) - upto
    if size:
        yield done(np.concatenate(held))


def near_links(filed: DataFrame, words: list[str], radius: int = 4, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect all nodes which share a key and whose fingerprints are within
    ``radius`` bits, from (key, node, fingerprint words)."""
    hot = cut(filed.groupBy("key").agg(F.ceil(F.count("*") / cell).alias("parts")).where("parts > 1"), "hot-keys")
    n = hot.count()
    met = filed.select(F.col("key").alias("cell"), "node", *words)
    if n:
        # the list of hot keys is only broadcast if it is short
        split = filed.join(F.broadcast(hot) if n <= FEW else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        split = split.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        # A part meets itself and each other part: cells for all pairs of parts; one part, one cell.
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        place = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
        met = split.select(place.alias("cell"), "node", *words)
    sorted_ = met.repartition("cell").sortWithinPartitions("cell", "node")
    return sorted_.mapInArrow(lambda batches: _links(batches, radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, th, fp, component): component is the smallest id that links of ``radius`` bits reach.

    A null text counts as empty; texts without words have fingerprint zero and link like any other.
    Rows with a null id take part but name no component unless they stand alone (then it is null).
    Repeated rows come back once each. An empty table gives none. Other columns are not read.
    """
    fps = cut(fingerprints(keyed(docs, id_col, text_col), shingle).withColumnRenamed("f0", "node"), "fingerprints")
    distinct = fps.groupBy("node").agg(F.min("id").alias("least"))
    filed = distinct.select(F.explode(band_keys(F.col("node"), radius)).alias("key"), "node", F.col("node").alias("f0"))
    links = near_links(filed, ["f0"], radius)
    roots = connected_components(links)
    classes = distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(classes.join(smallest, "root").select("node", "component"), "node").select("id", "th", F.col("node").alias("fp"), "component")


#: For near-duplicates at a similarity: fingerprint words.
LONG = 4
#: Texts whose shingle sets meet in one block when pairs are verified; larger groups are split.
BLOCK_NODES = 1024


def radius_for(similarity: float, words: int = LONG) -> int:
    """Differing bits that shingle sets with this Jaccard similarity hardly exceed: the mean and three
    standard deviations."""
    bits, share = 64 * words, float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return round(bits * share + 3 * (bits * share * (1 - share)) ** 0.5)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    return np.unique(shingle_digests(text, shingle))


def set_fingerprints(docs: DataFrame, shingle: int, words: int = LONG) -> DataFrame:
    """(id, th, node, f0, f1, ...) of a keyed table: ``node`` names the set of shingles, and the
    fingerprint words are of that set, so repeats inside a text count once."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for t in texts_of(batch):
                own = shingle_set(t, shingle)
                rows.append([xxhash.xxh64_intdigest(own.tobytes(), 42), *[majority(mix(own ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if k else own) for k in range(words)]])
            found = np.array(rows, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, k]) for k in range(words + 1)]], names=["id", "th", "node", *names])

    return docs.mapInArrow(run, "id long, th long, node long, " + ", ".join(f"{n} long" for n in names))


def prefix_groups(cells: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """Groups of rows (two at least, of one cell) that have a rare shingle in common: two sets with the
    Jaccard similarity at least are in one of the groups together.

    Such sets share that part of the larger one. So if all sets are put in one order, from the block's
    rarest shingle to its most frequent, they share a shingle among the first ones of each, as many as
    the other part and one more.
    """
    sizes = np.array([len(x) for x in sets])
    owner, shingles = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, which, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    order = np.lexsort((which, counts[which], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = order[place < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[owner]]
    first = first[counts[which[first]] > 1]
    first = first[np.lexsort((owner[first], which[first], cells[owner[first]]))]
    new = np.r_[True, (which[first][1:] != which[first][:-1]) | (cells[owner[first]][1:] != cells[owner[first]][:-1])] if len(first) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    for i, j in zip(starts, np.r_[starts[1:], len(first)], strict=True):
        if j - i > 1:
            yield owner[first[i:j]]


def _verified(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (block, root, node, shingles, fingerprint words) sorted by block and root: of each
    root's pairs within the radius those whose sets are similar enough, as far as they connect what
    others of the block have not; a block gives fewer links than it has rows. Only pairs with a rare
    shingle in common are looked at, so a family of texts that share a template costs little."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        cells, nodes = (np.array([r[k] for r in held], np.int64) for k in (1, 2))
        sets, fps = [np.frombuffer(r[3], np.uint64) for r in held], np.array([r[4:] for r in held], np.int64).view(np.uint64)
        top, out, seen = np.arange(len(held)), [], set()
        empty = np.flatnonzero([not len(x) for x in sets])
        for group in [*prefix_groups(cells, sets, similarity), *[empty[cells[empty] == c] for c in np.unique(cells[empty])]]:
            for k, a in enumerate(group[:-1].tolist()):
                others = group[k + 1 :]
                others = others[top[others] != top[a]]
                if not len(others):
                    continue
                others = others[np.bitwise_count(fps[others] ^ fps[a]).sum(axis=1) <= radius]
                x = sets[a]
                for b in others.tolist():
                    y = sets[b]
                    if top[a] == top[b] or (a, b) in seen or min(len(x), len(y)) < similarity * max(len(x), len(y)):
                        continue
                    seen.add((a, b))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both):
                        top[top == top[b]] = top[a]
                        out.append((nodes[a], nodes[b]))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][0] != row[0]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def verified_links(candidates: DataFrame, texts: DataFrame, names: list[str], shingle: int, radius: int, similarity: float) -> DataFrame:
    """Links that connect the nodes of one group of ``candidates`` (a, b) that are within the radius and
    whose sets of shingles have the Jaccard similarity at least; ``texts`` has (node, fingerprint
    words, text).

    Small groups of candidates share a block; a large one is split into blocks for all pairs of its
    parts. Pairs are made and verified inside a block and never leave it.
    """
    groups = cut(connected_components(candidates), "near-candidates")
    many = max(1, -(-groups.count() // BLOCK_NODES))
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("parts"))
    nodes = groups.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    nodes = nodes.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    block = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(many))).otherwise(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            own = pa.array([shingle_set(t, shingle).tobytes() for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), own, *batch.columns[2:]], names=["node", "shingles", *names])

    own = texts.select("node", "text", *names).join(groups.select("node"), "node", "left_semi").mapInArrow(sets, "node long, shingles binary, " + ", ".join(f"{n} long" for n in names))
    rows = nodes.select(block.alias("block"), "root", "node").join(own, "node").select("block", "root", "node", "shingles", *names)
    rows = rows.repartition("block").sortWithinPartitions("block", "root", "node")
    return rows.mapInArrow(lambda batches: _verified(batches, radius, similarity), "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id.

    Documents link where their sets of five-word shingles have the given Jaccard similarity at
    least; candidates are found by 256-bit fingerprints of the sets, every link is verified, groups
    are connected. Null texts are empty; texts without words are copies of each other; a null id is
    larger than any other; of repeated rows one stays. An empty table gives none. All columns stay
    as they are.
    """
    names = [f"f{k}" for k in range(LONG)]
    fps = cut(set_fingerprints(keyed(docs, id_col, text_col), shingle), "long-fingerprints")
    order = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("th").alias("th"))
    distinct = fps.groupBy("node").agg(*[F.min(n).alias(n) for n in names], F.min(order).alias("least"))
    radius = radius_for(similarity)
    bits, keys = key_plan(distinct.count(), similarity, LONG)
    candidates = cut(near_links(filed_by_keys(distinct, names, bits, keys), names, radius), "near-candidate-links")
    near = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    whose = distinct.join(near, "node", "left_semi").select("node", *names, F.col("least.id").alias("least_id"), F.col("least.th").alias("least_th"))
    texts = keyed(docs, id_col, text_col).join(whose, F.col("id").eqNullSafe(F.col("least_id")) & F.col("th").eqNullSafe(F.col("least_th"))).groupBy("node", *names).agg(F.first("text").alias("text"))
    links = cut(verified_links(candidates, texts, names, shingle, radius, similarity), "near-links")
    classes = distinct.join(connected_components(links), "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    id_, th, place = fresh(docs, "kept_id", "kept_th", "kept_place")
    kept = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias(id_), F.col("least.th").alias(th)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(th))
    rank = F.row_number().over(Window.partitionBy(id_, th).orderBy(th))
    return docs.join(kept, same).withColumn(place, rank).where(F.col(place) == 1).select(*docs.columns)
