"""Caches with a time to live as streams: exact keys, and nearest vectors of a bucket.

An entry is made by a miss and serves until ``ttl`` after it; hits don't extend it. Entries live in
state (of exact keys by buckets of keys), time is event time, and a timer lets an entry go once the watermark has passed its end.
A request is judged by the entries there are when it is processed: those of earlier micro-batches,
and in its own those of requests before it in order of time and id. The rows of one bucket in one
micro-batch are held together, so a trigger's size bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import by_bucket

TTL_SECONDS = 86_400
THRESHOLD = 0.92


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All of a bucket's rows in a micro-batch (Arrow may give them in several pieces) by time and id."""
    return pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable", ignore_index=True)


def micros(at: pd.Series) -> np.ndarray:
    return at.to_numpy().astype("datetime64[us]").astype(np.int64)


class ExactCache(StatefulProcessor):
    """Of each key of a bucket the time of its last miss; one timer a bucket lets go what has ended."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "keys array<string>, since array<long>, timer long")

    def _known(self) -> tuple[dict, int | None]:
        keys, since, timer = self.live.get() if self.live.exists() else ([], [], None)
        return dict(zip(keys, since, strict=True)), timer

    def _keep(self, known: dict, timer: int | None) -> None:
        if not known:
            return self.live.clear()
        if timer is None:
            timer = (min(known.values()) + self.ttl) // 1000
            self.handle.registerTimer(timer)
        self.live.update((list(known), list(known.values()), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = in_order(rows)
        known, timer = self._known()
        codes, keys = pd.factorize(got["key"], use_na_sentinel=False)
        got = got.iloc[np.argsort(codes, kind="stable")]  # by key, and in order still
        at, hit, end = micros(got["at"]), np.ones(len(got), bool), np.cumsum(np.bincount(codes))
        k = 0
        for name, stop in zip((None if pd.isna(n) else n for n in keys), end.tolist(), strict=True):
            mine, first = at[k:stop], k
            since = known.get(name)
            k = 0 if since is None else int(np.searchsorted(mine, since + self.ttl))
            while k < len(mine):  # a step for each miss; all requests until its end are hits
                hit[first + k], since = False, int(mine[k])
                k = int(np.searchsorted(mine, since + self.ttl))
            known[name], k = since, stop
        self._keep(known, timer)
        yield pd.DataFrame({"key": got["key"], "request_id": got["request_id"], "hit": hit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (known, _) = timerValues.getCurrentWatermarkInMs(), self._known()
        self._keep({k: since for k, since in known.items() if (since + self.ttl) // 1000 > now}, None)
        return iter(())

    def close(self) -> None:
        pass


def exact_hits(requests: DataFrame, key: str, at: str, ttl: int = TTL_SECONDS, late: str = "1 second") -> DataFrame:
    """(key, request_id, hit) of a stream of requests (``key``, request_id, ``at`` a timestamp).

    Requests without a time are left out; null is a key like others. Requests later than ``late`` behind
    the latest are dropped by the watermark.
    """
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"), F.col(at).alias("at")).where("at is not null")
    return by_bucket(rows.withWatermark("at", late), "key").transformWithStateInPandas(ExactCache(ttl), "key string, request_id long, hit boolean", "Append", "EventTime")


class VectorCache(StatefulProcessor):
    """Of each bucket the vectors of its misses that still live, as a map from (time, request)."""

    def __init__(self, ttl: int, threshold: float, log_only: bool) -> None:
        self.ttl, self.threshold, self.log_only = ttl * 1_000_000, threshold, log_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "at long, request_id long", "vector binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = in_order(rows)
        at, ids = micros(got["at"]), got["request_id"].to_numpy(np.int64)
        known = [(k[0], k[1], np.frombuffer(bytes(v[0]))) for k, v in self.entries.iterator()]
        times, made = [k[0] for k in known], [k[1] for k in known]
        store = _Rows([k[2] for k in known])
        out, starts = [], set(times)
        for t, i, vector in zip(at.tolist(), ids.tolist(), got["vector"], strict=True):
            unit = unit_vector(vector)
            near, like = None, None
            if unit is not None and times:
                likes = store.against(unit)
                likes[np.asarray(times) + self.ttl <= t] = -np.inf
                like = float(likes.max())
                near = min(made[k] for k in np.flatnonzero(likes == like)) if like > -np.inf else None
            hit = near is not None and like >= self.threshold and not self.log_only
            out.append((key[0], i, hit, near, round(like, 6) if near is not None else None))
            if not hit and unit is not None:
                times.append(t)
                made.append(i)
                store.add(unit)
                self.entries.updateValue((t, i), (unit.tobytes(),))
                if t not in starts:
                    starts.add(t)
                    self.handle.registerTimer((t + self.ttl) // 1000)
        yield pd.DataFrame(out, columns=["bucket", "request_id", "hit", "cached_id", "similarity"]).astype({"cached_id": "Int64", "similarity": "Float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        for k in [k for k in self.entries.keys() if (k[0] + self.ttl) // 1000 <= end]:
            self.entries.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


class _Rows:
    """A matrix that grows by rows: room doubles. Vectors of other lengths are like nothing."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.kept, self.at, self.n = {}, {}, 0
        for r in rows:
            self.add(r)

    def add(self, row: np.ndarray) -> None:
        d = len(row)
        matrix, places = self.kept.get(d, np.empty((4, d))), self.at.setdefault(d, [])
        if len(places) == len(matrix):
            matrix = np.concatenate([matrix, np.empty_like(matrix)])
        matrix[len(places)] = row
        self.kept[d] = matrix
        places.append(self.n)
        self.n += 1

    def against(self, unit: np.ndarray) -> np.ndarray:
        out = np.full(self.n, -np.inf)
        places = self.at.get(len(unit))
        if places:
            out[places] = self.kept[len(unit)][: len(places)] @ unit
        return out


def unit_vector(vector) -> np.ndarray | None:
    """The vector over its length; None for null, zero and non-finite ones: such a request is a miss and
    leaves no entry, as a cache mustn't fail what it serves."""
    if vector is None:
        return None
    v = np.array([np.nan if c is None else c for c in vector], float)
    length = float(np.sqrt(v @ v)) if len(v) else 0.0
    return v / length if length > 0 and np.isfinite(length) else None


def vector_hits(requests: DataFrame, bucket: str, at: str, vector: str, ttl: int = TTL_SECONDS, threshold: float = THRESHOLD, log_only: bool = False, late: str = "1 second") -> DataFrame:
    """(bucket, request_id, hit, cached_id, similarity) of a stream of requests: the most similar entry of
    the request's bucket (ties: smallest id) and whether it is similar enough; never if ``log_only``.

    A bucket is worked off in order, as each answer depends on the misses before it; buckets are the
    unit of concurrency. Requests without a time are left out.
    """
    rows = requests.select(F.col(bucket).cast("string").alias("bucket"), F.col("request_id").cast("long").alias("request_id"), F.col(at).alias("at"), F.col(vector).cast("array<double>").alias("vector")).where("at is not null")
    processor = VectorCache(ttl, threshold, log_only)
    return rows.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(processor, "bucket string, request_id long, hit boolean, cached_id long, similarity double", "Append", "EventTime")
