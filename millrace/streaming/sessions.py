"""Sessions as a stream: window, anchors, summary and facts of each conversation in typed state, by buckets of conversations.

A turn is a pair of a user's message and the answer to it. The window holds the last ``size`` pairs.
The oldest pair leaves as a whole: if the user's message is one to keep, both messages become
anchors, which never leave; otherwise the pair goes into the running summary. Facts told with a
message (a project's name, technologies) are merged into what is known and never forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.guardrails import is_anchor
from ..operators.sessions import ENVELOPE, LINE_CHARS, SUMMARY_CHARS, WINDOW
from .state import by_bucket, last_millis

OUT = "kind string, conv_id long, turn_index long, messages_in_window long, anchors_count long, evicted long, summary_chars long, project string, technologies string, messages string"
_PAIRS = "array<struct<question:string,answer:string,anchored:boolean>>"
_STATE = f"sessions array<struct<conv_id:bigint,turns:bigint,evicted:bigint,summary:string,question:string,anchored:boolean,waiting:boolean,project:string,until:bigint,window:{_PAIRS},anchors:{_PAIRS},words:array<string>>>, timer long"
_NEW = (0, 0, None, None, False, False, None, 0, [], [], [])


def first_lines(summary: str | None, question: str, answer: str) -> str:
    """The default summary: a line for each pair that has left, the question's beginning; the last characters stay."""
    line = question[:LINE_CHARS]
    return (line if summary is None else f"{summary}\n{line}")[-SUMMARY_CHARS:]


class Sessions(StatefulProcessor):
    def __init__(self, size: int, idle_ms: int, summarise: Callable[[str | None, str, str], str]) -> None:
        self.size, self.idle, self.summarise = size, idle_ms, summarise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", _STATE)

    def _known(self) -> tuple[dict[int, tuple], int | None]:
        found, timer = self.state.get() if self.state.exists() else ([], None)
        # pairs as plain tuples: nested rows can't be written back
        return {s[0]: (*s[1:9], [tuple(p) for p in s[9]], [tuple(p) for p in s[10]], s[11]) for s in found}, timer

    def _keep(self, known: dict[int, tuple], timer: int | None) -> None:
        if not known:
            return self.state.clear()
        if timer is None:
            timer = min(s[7] for s in known.values())
            self.handle.registerTimer(timer)
        self.state.update(([(k, *s) for k, s in known.items()], timer))

    def _after(self, conv: int, rows: list, end: int, state: tuple, out: list) -> tuple:
        """A session's state after more of its messages; ``out`` gets a row for each turn."""
        turns, evicted, summary, question, anchored, waiting, project, until, window, anchors, spelled = state
        window, anchors, spelled = [tuple(p) for p in window], [tuple(p) for p in anchors], list(spelled)
        seen = {s.lower() for s in spelled}
        for r in rows:
            project = r.project or project
            for word in r.technologies if r.technologies is not None else ():
                if word and word.lower() not in seen:
                    seen.add(word.lower())
                    spelled.append(word)
            if r.role == "user":
                question, anchored, waiting = r.text or "", bool(r.anchored), True
            elif r.role == "assistant" and waiting:
                window.append((question, r.text or "", anchored))
                turns, question, waiting = turns + 1, None, False
                if len(window) > self.size:
                    oldest = window.pop(0)
                    evicted += 1
                    if oldest[2]:
                        anchors.append(oldest)
                    else:
                        summary = self.summarise(summary, oldest[0], oldest[1])
                out.append(("turn", conv, turns, 2 * len(window), 2 * len(anchors), evicted, len(summary or ""), project, ",".join(spelled), None))
        return turns, evicted, summary, question, anchored, waiting, project, max(until, end), window, anchors, spelled

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Arrow may give a bucket's rows in several pieces: they are put in order together
        got = pd.concat(list(rows)).sort_values(["at", "turn", "role", "text"], kind="stable", ignore_index=True)
        (known, timer), out = self._known(), []
        last = last_millis(got, "conv_id")
        said: dict[int, list] = {}
        for r in got.itertuples(index=False):
            said.setdefault(r.conv_id, []).append(r)
        for conv, some in said.items():
            known[conv] = self._after(conv, some, last[conv] + self.idle, known.get(conv, _NEW), out)
        self._keep(known, timer)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Sessions have been idle: the last state of each is told, and let go."""
        now, (known, _) = timerValues.getCurrentWatermarkInMs(), self._known()
        idle, out = {k: s for k, s in known.items() if s[7] <= now}, []
        self._keep({k: s for k, s in known.items() if k not in idle}, None)
        for conv, (turns, evicted, summary, _, _, _, project, _, window, anchors, spelled) in idle.items():
            told = [f"user: {ENVELOPE}\n{summary}"] if summary else []
            told += [line for q, a, _ in [*anchors, *window] for line in (f"user: {q}", f"assistant: {a}")]
            out.append(("ended", conv, turns, 2 * len(window), 2 * len(anchors), evicted, len(summary or ""), project, ",".join(spelled), "\n".join(told)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def session_states(messages: DataFrame, size: int = WINDOW, idle_ms: int = 1_800_000, late: str = "1 second", summarise: Callable[[str | None, str, str], str] = first_lines) -> DataFrame:
    """Of a stream of messages (conv_id, at, turn, role, text, project, technologies) a row for each turn
    (``kind`` turn) with its session's state after it, and one (``kind`` ended) with the list of
    messages when a session has been idle for ``idle_ms`` by the watermark; what comes later begins anew.

    Other roles than user and assistant leave no trace but their facts. A question without an answer
    waits, and gives way to the next question; an answer without a question is left out. Messages
    without a conversation or a time are left out. Null texts are empty. What to keep is told by rules, or
    by a column ``judged`` where it isn't null.
    """
    rows = messages.where("conv_id is not null and at is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "at", F.col("turn").cast("long").alias("turn"), "role", "text", "project", "technologies", is_anchor(F.col("text"), F.col("judged") if "judged" in messages.columns else None).alias("anchored"))
    return by_bucket(rows.withWatermark("at", late), "conv_id").transformWithStateInPandas(Sessions(size, idle_ms, summarise), OUT, "Append", "EventTime")
