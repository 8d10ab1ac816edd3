"""Streams with typed state against plain Python, over micro-batches and a restart from the checkpoint."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import sessions as batch
from millrace.plans.streams import in_two_runs
from millrace.sources.storage import Scope, create_text, names, read_text
from millrace.streaming import caches, deltas, sessions


def at(seconds):
    return dt.datetime.fromtimestamp(1_704_067_200 + seconds, dt.timezone.utc)


def parts_of(spark, rows, schema, cuts):
    edges = [0, *cuts, len(rows)]
    return [spark.createDataFrame(rows[a:b], schema) for a, b in zip(edges, edges[1:], strict=False)]


def test_exact_cache(spark):
    rng = random.Random(3)
    rows = sorted((at(rng.randrange(4000)), k, rng.choice(["hot", "hot", "a", None])) for k in range(600))
    rows = [(i, key, t) for t, i, key in rows]
    want, since = {}, {}
    for i, key, t in rows:
        hit = key in since and t < since[key] + dt.timedelta(seconds=60)
        want[i] = hit
        since[key] = since[key] if hit else t
    late = [(9999, "hot", at(0)), (9998, "hot", None)]  # behind the watermark, and without a time
    got = in_two_runs(spark, parts_of(spark, rows + late, "request_id long, key string, at timestamp", (200, 400, 600)), lambda s: caches.exact_hits(s, "key", "at", 60, late="0 seconds"))
    got = {r["request_id"]: r["hit"] for r in got.collect()}
    # rows of exactly the watermark's time may be dropped where a part ends
    assert set(want) - set(got) <= {rows[k][0] for k in range(len(rows)) if rows[k][2] in (rows[199][2], rows[399][2])} and not {9999, 9998} & set(got)
    assert all(want[i] == hit for i, hit in got.items())


def plain_vectors(rows, ttl, threshold, log_only):
    out, entries = {}, {}
    for i, bucket, t, v in rows:
        unit = caches.unit_vector(v)
        live = [(float(e @ unit), -k) for s, k, e in entries.get(bucket, []) if t < s + dt.timedelta(seconds=ttl) and unit is not None and len(e) == len(unit)]
        best = max(((round(s, 9), k) for s, k in live), default=None)
        hit = bool(best and best[0] >= threshold and not log_only)
        out[i] = (hit, -best[1] if best else None)
        if not hit and unit is not None:
            entries.setdefault(bucket, []).append((t, i, unit))
    return out


def test_vector_cache(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5))
    rows = [(k, f"b{k % 2}", at(k), (centres[rng.integers(6)] + 0.05 * rng.normal(size=5)).tolist()) for k in range(200)]
    for k, odd in ((20, None), (31, [0.0] * 5), (42, [float("nan")] * 5), (53, [1.0, None, 0.0, 0.0, 0.0]), (64, []), (75, [1.0, 2.0]), (86, [1.0, 2.0])):
        rows[k] = (k, "b0", at(k), odd)
    for log_only in (False, True):
        got = in_two_runs(spark, parts_of(spark, rows, "request_id long, bucket string, at timestamp, v array<double>", (70, 140)), lambda s, quiet=log_only: caches.vector_hits(s, "bucket", "at", "v", ttl=50, threshold=0.95, log_only=quiet))
        got = {r["request_id"]: (r["hit"], r["cached_id"]) for r in got.collect()}
        assert got == plain_vectors(rows, 50, 0.95, log_only)
        assert any(h for h, _ in got.values()) != log_only


def plain_sessions(rows, size):
    """(conv, turn index) -> window, anchors, evicted, summary; by the rule that pairs leave as a whole."""
    out, state = {}, {}
    for conv, _, _, role, text, *_ in rows:
        s = state.setdefault(conv, {"w": [], "a": [], "n": 0, "gone": 0, "sum": None, "q": None})
        if role == "user":
            s["q"] = text or ""
        elif role == "assistant" and s["q"] is not None:
            s["w"].append((s["q"], text or ""))
            s["q"], s["n"] = None, s["n"] + 1
            if len(s["w"]) > size:
                pair = s["w"].pop(0)
                s["gone"] += 1
                if "GDPR" in pair[0]:
                    s["a"].append(pair)
                else:
                    s["sum"] = pair[0][:80] if s["sum"] is None else f"{s['sum']}\n{pair[0][:80]}"[-2000:]
            out[conv, s["n"]] = (2 * len(s["w"]), 2 * len(s["a"]), s["gone"], len(s["sum"] or ""))
    return out


def test_sessions_as_stream_and_as_table(spark):
    rng = random.Random(6)
    rows = []
    for turn in range(60):
        for conv in range(4):
            role = rng.choice(["user", "assistant"] * 4 + ["system"]) if conv else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", f"turn {turn} é" * rng.randint(1, 12), f"needs GDPR {turn}"])
            rows.append((conv, at(60 * turn), turn, role, text, rng.choice([None, "", f"p{turn}"]), rng.choice([None, [], [f"T{turn % 5}", f"t{turn % 5}", None, ""]])))
    schema = "conv_id long, at timestamp, turn long, role string, text string, project string, technologies array<string>"
    end = (99, at(10**6), 0, "system", None, None, None)
    got = in_two_runs(spark, parts_of(spark, [*rows, end], schema, (80, 160, 240)), lambda s: sessions.session_states(s, 3, idle_ms=7_200_000)).collect()
    want = plain_sessions(rows, 3)
    turns = {(r["conv_id"], r["turn_index"]): (r["messages_in_window"], r["anchors_count"], r["evicted"], r["summary_chars"]) for r in got if r["kind"] == "turn"}
    assert turns == want
    table = batch.pairs(spark.createDataFrame(rows, schema))
    assert {(r["conv_id"], r["turn_index"]): (r["messages_in_window"], r["anchors_count"], r["evicted"], r["summary_chars"]) for r in batch.pair_states(table, 3).collect()} == want
    ended = {r["conv_id"]: (r["turn_index"], r["messages_in_window"], r["anchors_count"], r["evicted"], r["summary_chars"], r["messages"]) for r in got if r["kind"] == "ended"}
    assert ended == {r["conv_id"]: (r["turn_index"], r["messages_in_window"], r["anchors_count"], r["evicted"], r["summary_chars"], r["messages"]) for r in batch.snapshots(table, 3).collect()}
    for r in got:
        if r["kind"] == "ended":
            assert r["project"] == [x[5] for x in rows if x[0] == r["conv_id"] and x[5]][-1]
            spelled = [w for x in rows if x[0] == r["conv_id"] for w in x[6] or [] if w]
            assert r["technologies"].split(",") == [w for k, w in enumerate(spelled) if w.lower() not in [v.lower() for v in spelled[:k]]]


def test_a_session_that_goes_on_after_its_end_begins_anew(spark):
    row = lambda s, turn, role: (1, at(s), turn, role, f"{role} {turn}", None, None)
    schema = "conv_id long, at timestamp, turn long, role string, text string, project string, technologies array<string>"
    rows = [row(0, 0, "user"), row(1, 1, "assistant"), (2, at(9000), 0, "system", None, None, None), row(20000, 2, "user"), row(20001, 3, "assistant")]
    joined = lambda old, q, a: "gone"
    got = in_two_runs(spark, parts_of(spark, rows, schema, (2, 3)), lambda s: sessions.session_states(s, 1, idle_ms=1000, summarise=joined)).collect()
    assert sorted((r["kind"], r["turn_index"]) for r in got if r["conv_id"] == 1) == [("ended", 1), ("turn", 1), ("turn", 1)]


def test_folders_and_files_made_at_once(spark):
    other = Scope(spark, "test")
    with Scope(spark, "test") as scope:
        path = scope.folder("x/file.json")
        assert create_text(spark, path, "é1") and not create_text(spark, path, "2")
        assert read_text(spark, path) == "é1" and names(spark, scope.folder("x")) == ["file.json"] and names(spark, scope.folder("y")) == []
        spark.range(3).write.parquet(scope.folder("rows"))
        spark.range(2).write.parquet(other.folder("rows"))
        inner = Scope(spark, "inner")  # what operators make for themselves
        spark.range(2).write.parquet(inner.folder("rows"))
        assert inner.root.startswith(scope.root)
    assert names(spark, scope.root) == names(spark, inner.root) == [] and spark.read.parquet(other.folder("rows")).select(F.count("*")).first()[0] == 2
    assert not Scope(spark, "test").root.startswith(scope.root)
    assert other.close() and not other.close()


def test_deltas_out_of_order_twice_and_cut_off(spark):
    rng = random.Random(9)
    whole, rows = {}, []
    for stream in range(12):
        n = rng.randint(1, 9)
        parts = [rng.choice(["a", "é ", "", None, "end"]) for _ in range(n)]
        whole[stream] = ("".join(p or "" for p in parts), n, stream % 4 != 0)
        rows += [(stream, at(0), k, p, k == n - 1 and stream % 4 != 0) for k, p in enumerate(parts)]
    rng.shuffle(rows)
    twice = rows + rng.sample(rows, 20) + [(None, at(0), 0, "x", True), (5, at(0), None, "x", True)]
    later = [(0, at(1), 0, "late", False), (1, at(2), 0, "late", False), (99, at(10**6), 0, None, False)]
    schema = "stream_id long, at timestamp, seq long, delta string, done boolean"
    got = in_two_runs(spark, parts_of(spark, [*twice, *later], schema, (25, len(twice), len(twice) + 2)), lambda s: deltas.assembled_stream(s, 60_000)).collect()
    assert sorted((r["stream_id"], r["text"], r["deltas"], r["complete"]) for r in got) == sorted((k, *v) for k, v in whole.items())


def test_a_part_is_one_micro_batch_of_many_files(spark, monkeypatch):
    from millrace.plans import streams as plans

    seen = []
    monkeypatch.setattr(plans, "run_on", lambda stream, out, state, settle, run=plans.run_on: seen.append(len(set(spark.read.option("recursiveFileLookup", True).parquet(out.replace("/out", "/in")).inputFiles()))) or run(stream, out, state, settle))
    rows = spark.range(40).selectExpr("id as request_id", "cast(id % 7 as string) as key", "timestamp_seconds(1704067200 + id) as at").repartition(4)
    got = in_two_runs(spark, [rows.where("request_id < 20"), rows.where("request_id >= 20")], lambda s: caches.exact_hits(s, "key", "at", 3600))
    assert seen[0] == 4 and seen[1] == 8  # not one task that writes all of a part
    assert {r["request_id"] for r in got.where("not hit").collect()} == set(range(7))


def test_partitions_of_state_follow_the_cores(spark):
    from millrace.streaming.state import PARTITIONS_A_CORE, typed_state

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        with typed_state(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == PARTITIONS_A_CORE * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "5000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class Handle:
    """State and timers of one bucket, in memory; counts what would be round trips."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


def test_one_call_serves_all_keys_of_a_bucket():
    import pandas as pd

    handle, cache = Handle(), caches.ExactCache(60)
    cache.init(handle)
    rows = pd.DataFrame({"key": [str(k % 500) for k in range(1000)], "request_id": range(1000), "at": pd.to_datetime([1_704_067_200 + k // 500 for k in range(1000)], unit="s")})
    out = pd.concat(cache.handleInputRows((0,), iter([rows]), None))
    assert set(out.loc[~out["hit"], "request_id"]) == set(range(500)) and handle.calls < 10 and len(handle.timers) == 1


def test_one_call_puts_all_streams_of_a_bucket_together():
    import pandas as pd

    handle, assembler = Handle(), deltas.Assembler(1000)
    assembler.init(handle)
    rows = pd.DataFrame({"stream_id": [k % 300 for k in range(600)], "seq": [k // 300 for k in range(600)], "delta": ["a"] * 600, "done": [k >= 300 and k % 2 == 0 for k in range(600)], "at": pd.to_datetime([1_704_067_200] * 600, unit="s")})
    out = pd.concat(assembler.handleInputRows((0,), iter([rows]), None))
    assert set(out["stream_id"]) == set(range(0, 300, 2)) and set(out["text"]) == {"aa"} and handle.calls < 10 and handle.timers == [1_704_067_201_000]


def test_one_call_holds_all_sessions_of_a_bucket_also_those_without_news():
    import pandas as pd

    def message(conv, turn):
        return (conv, turn, ("user", "assistant")[turn % 2], f"t{turn}", None, None, False, pd.Timestamp(1_704_067_200 + turn, unit="s"))

    handle, held = Handle(), sessions.Sessions(1, 1000, sessions.first_lines)
    held.init(handle)
    columns = ["conv_id", "turn", "role", "text", "project", "technologies", "anchored", "at"]
    rows = pd.DataFrame([message(c, t) for c in range(200) for t in range(4)], columns=columns)
    out = pd.concat(held.handleInputRows((0,), iter([rows]), None))
    assert len(out) == 400 and set(out.loc[out["turn_index"] == 2, "evicted"]) == {1} and handle.calls < 10
    handle.calls, news = 0, pd.DataFrame([message(7, t) for t in (4, 5)], columns=columns)
    out = pd.concat(held.handleInputRows((0,), iter([news]), None))
    assert out[["conv_id", "turn_index"]].values.tolist() == [[7, 3]] and handle.calls < 10 and len(handle.value[0]) == 200


def test_parts_of_one_run_are_not_late_for_each_other(spark):
    rows = [(1, at(0), 1, "b", False), (1, at(60), 0, "a", False), (1, at(0), 2, "c", True), (9, at(10**6), 0, "", False)]
    got = in_two_runs(spark, parts_of(spark, rows, "stream_id long, at timestamp, seq long, delta string, done boolean", (1, 2, 3)), lambda s: deltas.assembled_stream(s, 3_600_000)).collect()
    assert [(r["text"], r["complete"]) for r in got if r["stream_id"] == 1] == [("abc", True)]
