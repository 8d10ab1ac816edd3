"""Texts put together from streams of deltas that may come out of order and more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import by_bucket, last_millis

OUT = "stream_id long, text string, deltas long, repeats long, complete boolean"


_STATE = "streams array<struct<id:bigint,upto:bigint,text:string,last:bigint,repeats:bigint,told:boolean,until:bigint,waiting:array<bigint>,deltas:array<string>>>, timer long"


class Assembler(StatefulProcessor):
    """State, of each stream of a bucket: the text without gaps so far, and the deltas with their numbers that wait
    for a gap to close. One timer a bucket lets go the streams that have been idle."""

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streams", _STATE)

    def _known(self) -> tuple[dict[int, tuple], int | None]:
        streams, timer = self.state.get() if self.state.exists() else ([], None)
        return {s[0]: tuple(s[1:]) for s in streams}, timer

    def _keep(self, known: dict[int, tuple], timer: int | None) -> None:
        if not known:
            return self.state.clear()
        if timer is None:
            timer = min(s[5] for s in known.values())
            self.handle.registerTimer(timer)
        self.state.update(([(k, *s) for k, s in known.items()], timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        (known, timer), out = self._known(), []
        ends = last_millis(got, "stream_id")
        deltas: dict[int, list] = {}
        for stream, *delta in zip(*(got[c].tolist() for c in ("stream_id", "seq", "delta", "done")), strict=True):
            deltas.setdefault(stream, []).append(delta)
        for stream, some in deltas.items():
            upto, text, last, repeats, told, until, numbers, texts = known.get(stream, (0, "", None, 0, False, 0, [], []))
            waiting, parts = dict(zip(numbers, texts, strict=True)), [text]
            for seq, delta, done in some:
                if seq < upto or seq in waiting:
                    repeats += 1
                else:
                    waiting[seq] = delta or ""
                if done:
                    last = seq
                while upto in waiting:
                    parts.append(waiting.pop(upto))
                    upto += 1
            text = "".join(parts)
            whole = last is not None and upto > last and not told
            if whole:
                out.append((stream, text, upto, repeats, True))
            # a text that was told is let go; its number stays, so that late repeats don't tell it again
            known[stream] = (upto, "" if whole or told else text, last, repeats, whole or told, max(until, ends[stream] + self.idle), list(waiting), list(waiting.values()))
        self._keep(known, timer)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing has come for long: what there is up to the first gap is told as it is."""
        now, (known, _) = timerValues.getCurrentWatermarkInMs(), self._known()
        idle = {k: s for k, s in known.items() if s[5] <= now}
        self._keep({k: s for k, s in known.items() if k not in idle}, None)
        yield self._rows([(k, text, upto, repeats, False) for k, (upto, text, _, repeats, told, *_) in idle.items() if not told])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def assembled_stream(deltas: DataFrame, idle_ms: int = 600_000, late: str = "1 second") -> DataFrame:
    """(stream_id, text, deltas, repeats, complete) of a stream of deltas (stream_id, at, seq from 0, delta, done).

    A text is told once, when the delta marked ``done`` and all before it are there. A stream that stops
    earlier is told after ``idle_ms`` as incomplete, up to its first gap. Of a number that comes twice
    the first delta counts. Rows without an id, a number or a time are left out.
    """
    rows = deltas.select(F.col("stream_id").cast("long").alias("stream_id"), "at", F.col("seq").cast("long").alias("seq"), "delta", F.coalesce("done", F.lit(False)).alias("done")).where("stream_id is not null and seq >= 0 and at is not null")
    return by_bucket(rows.withWatermark("at", late), "stream_id").transformWithStateInPandas(Assembler(idle_ms), OUT, "Append", "EventTime")
