"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised with its own centroids (fitted on a bounded sample);
a pair of centroids is a cell. A query walks over pairs by summed distance with a heap until its
cells hold enough vectors, and reranks exactly the entries of these cells. How many are enough is
measured: on the sample, against brute force, for the recall that is asked for. Vectors with
structure need few; vectors without any (as random ones) need a large share whatever the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Centroids of each half are about the square root of the number of vectors, so that there are about
#: as many cells; at most ``CENTROIDS`` (the codebooks and the cells' counts are held by every task).
CENTROIDS = 1024
#: Rows on which the centroids are fitted, taken by hash of the id, and those that ask to calibrate.
FIT_ROWS, ASKING = 20_000, 256
ROUNDS = 10
#: Recall that the share of vectors to rerank is calibrated for.
RECALL = 0.93
NEIGHBOURS = 20
#: Groups of cells; each gives a query's best of its own, whatever the size of the table.
GROUPS = 16
#: Queries that one task holds; more take turns. Their best entries so far are cut back to k at ``HITS``.
QUERY_ROWS, HITS = 1 << 14, 1 << 20
#: Queries, and vectors, that are scored at once.
BLOCK, VECTORS = 256, 2048


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, not all zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """k-means (Lloyd) on the sample; fewer distinct rows give fewer centroids."""
    distinct = np.unique(sample, axis=0)
    if len(distinct) <= k:
        return distinct
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        nearest = distances(sample, centroids).argmin(axis=1)
        for c in range(k):
            if (mine := nearest == c).any():
                centroids[c] = sample[mine].mean(axis=0)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, up to a term of the point alone."""
    return (centroids**2).sum(axis=1) - 2 * points @ centroids.T


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells with vectors in order of first[i] + second[j] until they hold ``wanted`` (multi-sequence walk).

    The heap has the next pair of every row that has begun; a row begins when the one before it has.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    n, held, out = len(b), 0, []
    count = sizes.reshape(len(a), n)[np.ix_(a, b)].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap and held < wanted:
        _, i, j = heap[0]
        if j + 1 < n:
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if count[i][j]:
            out.append(a[i] * n + b[j])
            held += count[i][j]
    return out


class MultiIndex:
    """The two codebooks: bounded by twice ``CENTROIDS`` half vectors."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.half = sample.shape[1] // 2
        self.books = fit_centroids(sample[:, : self.half], k), fit_centroids(sample[:, self.half :], k)
        self.cells = len(self.books[0]) * len(self.books[1])

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        first = distances(vectors[:, : self.half], self.books[0]).argmin(axis=1)
        return first * len(self.books[1]) + distances(vectors[:, self.half :], self.books[1]).argmin(axis=1)

    def halves(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each half's distances to its centroids: for inner products, the negative inner product. Summed
        in a fixed order, so that all tasks agree on them to the last bit."""
        return -inner_products(queries[:, : self.half], self.books[0]), -inner_products(queries[:, self.half :], self.books[1])

    def probe(self, queries: np.ndarray, sizes: np.ndarray, wanted: int) -> list[list[int]]:
        """Cells for each query."""
        return [walk(f, s, sizes, wanted) for f, s in zip(*self.halves(queries), strict=True)]

    def share(self, sample: np.ndarray, total: int, k: int, recall: float) -> float:
        """The share of all vectors that a query's cells must hold, so that of the sample's nearest
        vectors ``recall`` are among them. As many are asked for as are within the same distance as
        ``k`` of ``total``, one at least."""
        n, k = len(sample), max(1, round(k * min(1.0, len(sample) / max(1, total))))
        asking = sample[:: max(1, n // ASKING)][:ASKING]
        own = np.arange(n)[:: max(1, n // ASKING)][:ASKING]
        if n <= k + 1:
            return 1.0
        exact = asking @ sample.T
        exact[np.arange(len(own)), own] = -np.inf
        nearest = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        cells = self.assign(sample)
        first, second = self.halves(asking)
        near = first[:, cells // len(self.books[1])] + second[:, cells % len(self.books[1])]
        limits = np.take_along_axis(near, nearest, axis=1)
        near.sort(axis=1)
        ranks = np.concatenate([np.searchsorted(r, x, "right") for r, x in zip(near, limits, strict=True)]) / n
        return float(np.quantile(ranks, recall))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assign(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int32())], names=["id", "v", "cell"])

    return run


def _probe(index: MultiIndex, sizes: np.ndarray, wanted: int, first: np.ndarray, parts: np.ndarray):
    """A row for each query and group in which it has cells, with the distance of its last cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                near, far = index.halves(_matrix(block.column(1)))
                rows, where, limits = [], [], []
                for row, found in enumerate(walk(f, s, sizes, wanted) for f, s in zip(near, far, strict=True)):
                    if not found:
                        continue
                    cells = np.array(found)
                    begin, n = first[cells], parts[cells]
                    mine = np.unique(np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    rows.append(np.full(len(mine), row))
                    where.append(mine)
                    limits.append(np.full(len(mine), near[row, cells[-1] // far.shape[1]] + far[row, cells[-1] % far.shape[1]]))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where), pa.int32()), block.column(0).take(take), block.column(1).take(take), pa.array(np.concatenate(limits))], names=["part", "id", "v", "last"])

    return run


def pack_cells(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First part of each cell and its number of parts: neighbouring small cells share a part of at
    most ``most`` vectors, a larger cell has parts of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    part, held = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            part, held = part + 1, 0
        first[c], parts[c] = part, max(1, -(-n // most))
        held += n
        if parts[c] > 1:
            part, held = part + int(parts[c]), 0
    return first, parts


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, each summed in the order of components, so equal vectors score equally."""
    out = np.zeros((len(queries), len(vectors)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    return out


_HITS = "query_id long, vec_id long, score double"


def top(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    return order[rank < k]


class _Turn:
    """The queries of one turn, and their best entries among the vectors of a group so far."""

    def __init__(self, index: MultiIndex, k: int) -> None:
        self.index, self.k = index, k
        self.asked: list[tuple] = []
        self.found: list[tuple] = []
        self.size = 0

    def gather(self) -> None:
        if len(self.asked) > 1:
            self.asked = [tuple(np.concatenate([a[x] for a in self.asked]) for x in range(3))]

    def search(self, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray) -> None:
        """Reranks these vectors for all queries whose cells they are in: cells up to the last one's distance."""
        self.gather()
        qids, queries, last = self.asked[0]
        own, place = np.unique(cells, return_inverse=True)
        for at in range(0, len(qids), BLOCK):
            q = slice(at, at + BLOCK)
            first, second = self.index.halves(queries[q])
            near = first[:, own // second.shape[1]] + second[:, own % second.shape[1]] <= last[q, None]
            rows, columns = [], []
            for row in np.flatnonzero(near.any(axis=1)):
                mine = np.flatnonzero(near[row, place])
                mine = mine[ids[mine] != qids[at + row]]  # not the query's own row
                if len(mine) > self.k:
                    scores = vectors[mine] @ queries[at + row]
                    # the k-th largest, less what another order of summing may change
                    mine = mine[scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k] - 1e-9 * (1 + np.abs(scores).max())]
                rows.append(np.full(len(mine), at + row))
                columns.append(mine)
            if not rows:
                continue
            rows, columns = np.concatenate(rows), np.concatenate(columns)
            scores = np.zeros(len(rows))
            for d in range(queries.shape[1]):  # summed in the order of components, so equal vectors score equally
                scores += queries[rows, d] * vectors[columns, d]
            self.found.append((rows, ids[columns], scores))
            self.size += len(rows)
        if self.size > HITS:
            self.shrink()

    def shrink(self) -> None:
        rows, ids, scores = (np.concatenate([f[x] for f in self.found]) for x in range(3))
        best = top(rows, ids, scores, self.k)
        self.found, self.size = [(rows[best], ids[best], scores[best])], len(best)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.shrink()
            rows, ids, scores = self.found[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.asked[0][0][rows]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def _rerank(index: MultiIndex, k: int):
    """Rows (part, turn, kind, id, v, cell, last) sorted by part, turn, kind, cell: the queries of a turn
    (bounded), then the group's vectors, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turn = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, turns, kinds, ids, cells, last = (batch.column(c).to_numpy() for c in (0, 1, 2, 3, 5, 6))
            matrix = _matrix(batch.column(4))
            edges = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (turns[1:] != turns[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, b in zip(edges, np.r_[edges[1:], len(parts)], strict=True):
                if (parts[a], turns[a]) != key:
                    if turn:
                        yield from turn.result()
                    key, turn = (parts[a], turns[a]), _Turn(index, k)
                if kinds[a] == 0:
                    turn.asked.append((ids[a:b], matrix[a:b], last[a:b]))
                elif turn.asked:
                    for at in range(a, b, VECTORS):
                        some = slice(at, min(at + VECTORS, b))
                        turn.search(ids[some], matrix[some], cells[some])
        if turn:
            yield from turn.result()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL, share: float | None = None, centroids: int | None = None, fit_rows: int = FIT_ROWS, groups: int = GROUPS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors by inner product.

    Every vector is indexed; the codebooks are fitted on the ``fit_rows`` rows with the smallest
    id hashes, and on them the ``share`` of all vectors that a query reranks is calibrated for
    ``recall`` unless it is given. A query's own id is never its neighbour. Ranks go by score, ties
    by smaller id; fewer than k candidates give fewer rows. Vectors that are null, zero, of another
    length than the first by id hash, or hold null or non-finite components take no part, and neither do
    null ids. Rows that repeat an id are candidates each. Empty tables give no rows. Other columns
    are not read.

    Neighbouring cells make up ``groups`` groups of about equal size; larger cells are split by id
    hash. A task holds about ``query_rows`` queries and streams the vectors of one group, so
    it holds no large cell, and a query has at most k rows from each group. To the driver go the
    sample and one count a cell.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base, asked = pick(vectors), pick(queries)
    rows = base.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    width = len(rows[0][1])
    base, asked = base.where(F.size("v") == width), asked.where(F.size("v") == width)
    total, n_asked = base.count(), asked.count()
    sample = np.array([r[1] for r in rows if len(r[1]) == width])
    index = MultiIndex(sample, centroids or min(CENTROIDS, max(2, round(total**0.5))))
    filed = cut(base.mapInArrow(_assign(index), "id long, v array<double>, cell int"), "multi-index")
    sizes = np.zeros(index.cells, np.int64)
    for cell, n in filed.groupBy("cell").count().collect():
        sizes[cell] = n
    wanted = int(np.ceil((index.share(sample, total, k, recall) if share is None else share) * total))
    first, parts = pack_cells(sizes, max(1, -(-total // groups)))
    turns = max(1, -(-n_asked // query_rows))
    tasks = int(first[-1] + parts[-1]) * turns
    places = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(sizes)], "cell int, first int, parts int")
    # one row a cell
    left = filed.join(F.broadcast(places), "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    left = left.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"), "turn", F.lit(1).alias("kind"), "id", "v", "cell", F.lit(0.0).alias("last"))
    right = asked.mapInArrow(_probe(index, sizes, wanted, first, parts), "part int, id long, v array<double>, last double")
    right = right.select("part", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn"), F.lit(0).alias("kind"), "id", "v", F.lit(0).alias("cell"), "last")
    met = left.union(right).repartition(2 * tasks, "part", "turn").sortWithinPartitions("part", "turn", "kind", "cell")
    hits = met.mapInArrow(_rerank(index, k), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
