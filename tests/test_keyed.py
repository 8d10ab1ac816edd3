import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators.privacy import MappingStore
from millrace.sources.keyed import KeyedTable, latest
from millrace.sources.storage import Scope, names
from millrace.streaming import events
from millrace.streaming.state import feed

SCHEMA = "k long, at long, v string"


@pytest.fixture
def scope(spark):
    s = Scope(spark, "keyed")
    yield s
    s.close()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_rewrite_only_touched_buckets(spark, scope):
    table = KeyedTable.create(spark, scope.folder("t"), SCHEMA, ["k"], buckets=8)
    merge, want = latest(["k"], "at"), {}
    assert table.read().count() == 0
    for round_, keys in enumerate((range(100), range(50, 120), [7, 7, None], [7])):
        rows = [(k, round_ if k != 7 or round_ != 3 else -5, f"{round_}") for k in keys]
        table.upsert(spark.createDataFrame(rows, SCHEMA), merge)
        for r in rows:
            want[r[0]] = max(want.get(r[0], r), r, key=lambda x: x[1])
    assert rows_of(table.read()) == sorted(want.values(), key=str) and table.version() == 4
    before, after = table.manifest(3).folders, table.manifest(4).folders
    assert sum(before[b] != after[b] for b in after) == 1
    assert rows_of(KeyedTable(spark, scope.folder("t")).read(1)) == sorted(((k, 0, "0") for k in range(100)), key=str)
    # another table of that name is the one that is there
    assert KeyedTable.create(spark, scope.folder("t"), SCHEMA, ["k"], buckets=99).manifest().buckets == 8
    table.rebucket(3)
    assert table.manifest().buckets == 3 and rows_of(table.read()) == sorted(want.values(), key=str)
    assert table.vacuum() > 0 and rows_of(table.read()) == sorted(want.values(), key=str) and len(names(spark, scope.folder("t/manifest"))) == 1
    gone = table.remove(spark.createDataFrame([(7,), (None,), (12345,)], "k long"))
    assert rows_of(gone) == sorted([want.pop(7), want.pop(None)], key=str) and rows_of(table.read()) == sorted(want.values(), key=str)
    version = table.version()
    assert table.upsert(spark.createDataFrame([], SCHEMA), merge) == version == table.version()


def test_a_writer_that_dies_leaves_the_old_table(spark, scope):
    table = KeyedTable.create(spark, scope.folder("t"), SCHEMA, ["k"], buckets=4)
    table.upsert(spark.createDataFrame([(k, 0, "a") for k in range(20)], SCHEMA), latest(["k"], "at"))

    def dies(old, new):
        return old.unionByName(new).withColumn("v", F.when(F.col("k") == 11, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="killed"):
        table.upsert(spark.createDataFrame([(k, 1, "b") for k in range(20)], SCHEMA), dies)
    assert table.version() == 1 and {r["v"] for r in table.read().collect()} == {"a"} and names(spark, scope.folder("t/staged")) == []


def test_the_second_of_two_writers_starts_again(spark, scope):
    table = KeyedTable.create(spark, scope.folder("t"), SCHEMA, ["k"], buckets=1)
    other, merge, calls = KeyedTable(spark, scope.folder("t")), latest(["k"], "at"), []

    def slow(old, new):
        if not calls:
            calls.append(other.upsert(spark.createDataFrame([(1, 5, "other")], SCHEMA), merge))
        return merge(old, new)

    assert table.upsert(spark.createDataFrame([(1, 1, "mine"), (2, 1, "mine")], SCHEMA), slow) == 2
    assert rows_of(table.read()) == [(1, 5, "other"), (2, 1, "mine")]


def test_a_stream_goes_on_after_a_restart_and_is_not_doubled(spark, scope):
    path = scope.folder("s")

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(scope.folder("in"))

    feed(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), scope.folder("in"), 1)
    assert rows_of(events.upserted(stream(), "k", "at", path)) == [(1, 1, "a"), (2, 1, "a")]
    feed(spark.createDataFrame([(2, 2, "b"), (3, 2, "b")], SCHEMA), scope.folder("in"), 2)
    assert rows_of(events.upserted(stream(), "k", "at", path)) == [(1, 1, "a"), (2, 2, "b"), (3, 2, "b")]
    table = KeyedTable(spark, f"{path}/table")
    assert table.manifest().applied == {"rows": 1}
    version = table.upsert(spark.createDataFrame([(9, 9, "z")], SCHEMA), latest(["k"], "at"), "rows", 1)  # told again
    assert version == table.version() == 2 and table.read().count() == 3


def test_mapping_grows_and_forgets(spark, scope):
    store = MappingStore(spark, scope.folder("m"), "key", buckets=4)
    cell = lambda rows: spark.createDataFrame(rows, "entity_type string, value string, source_name string, seen_at timestamp")
    day = lambda n: dt.datetime(2024, 1, n)
    store.record(cell([("PERSON", "Ana", "b", day(2)), ("PERSON", "Ana", "a", day(2)), ("EMAIL_ADDRESS", "Ana", "c", day(3)), ("PERSON", None, "a", day(1))]))
    looked = cell([("PERSON", "Ana", "", day(1)), ("EMAIL_ADDRESS", "Ana", "", day(1)), ("PERSON", "Bo", "", day(1))])
    first = {(r["entity_type"], r["value"]): r["pseudonym"] for r in store.lookup(looked).collect()}
    assert first["PERSON", "Bo"] is None and first["PERSON", "Ana"] and first["EMAIL_ADDRESS", "Ana"].endswith("@example.org")
    store.record(cell([("PERSON", "Ana", "z", day(1)), ("PERSON", "Bo", "z", day(9))]))
    again = {(r["entity_type"], r["value"]): r["pseudonym"] for r in store.lookup(looked).collect()}
    assert {k: again[k] for k in first if k[1] == "Ana"} == {k: first[k] for k in first if k[1] == "Ana"}
    ana = store.table.read().where("entity_type = 'PERSON'").orderBy(F.desc("occurrences")).first()
    assert (ana["occurrences"], ana["source_name"], ana["first_seen_at"]) == (3, "a", day(2))
    assert store.find(spark.createDataFrame([(again["PERSON", "Bo"],)], "pseudonym string")).count() == 1
    gone = store.forget(spark.createDataFrame([("Ana",), ("never",), (None,)], "value string"))
    assert sorted(r["entity_type"] for r in gone.collect()) == ["EMAIL_ADDRESS", "PERSON"] and store.table.read().count() == 1
    assert store.forget(spark.createDataFrame([("never",)], "value string")).count() == 0
    store.record(cell([("PERSON", "Ana", "q", day(20))]))
    assert {(r["entity_type"], r["value"]): r["pseudonym"] for r in store.lookup(looked).collect()}["PERSON", "Ana"] not in (None, first["PERSON", "Ana"])
