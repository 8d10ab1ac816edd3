import os
import tracemalloc

import pyarrow as pa

from millrace.operators import ingest
from millrace.sources import folders
from millrace.sources.storage import Scope

SOURCES = [{"name": "notes", "location": "lake://a/notes", "format": "txt"}, {"name": "bodies", "location": "lake://b", "format": "pdf", "pattern": "*.txt"}, {"name": "missing", "location": "lake://c", "format": "txt"}]


def put(root, path, text, modified=None):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)
    if modified is not None:
        os.utime(f"{root}/{path}", (modified, modified))


def laid_out(root):
    put(root, "a/notes/x/1.txt", "[00:00:01] Ana: hello\n[00:00:02] Bo: there", 1000)
    put(root, "a/notes/2.txt", "one\n\ntwo é", 2000)
    put(root, "a/notes/_hidden/3.txt", "no", 2000)
    put(root, "a/notes/.4.txt", "no", 2000)
    put(root, "b/p.txt", "--- Page 1 ---\nfirst\n--- Page 2 ---\nsecond", 3000)
    put(root, "b/p.csv", "no", 3000)


def test_files_of_a_catalog(spark, tmp_path):
    laid_out(tmp_path)
    got = folders.catalog_files(spark, SOURCES, str(tmp_path))
    assert sorted((r["source"], r["name"], r["content"].decode()[:3], r["error"]) for r in got.collect()) == [("bodies", "p.txt", "---", None), ("notes", "1.txt", "[00", None), ("notes", "2.txt", "one", None)]
    assert all(r["bytes"] == len(r["content"]) for r in got.collect())
    assert got.agg({"modified": "min"}).first()[0].timestamp() == 1000
    both = got.where("source = 'notes'").unionByName(got.where("source = 'bodies'"))  # two conditions on one table
    assert both.count() == 3
    assert folders.catalog_files(spark, SOURCES, f"file://{tmp_path}", modifiedAfter="1970-01-01T00:20:00+00:00", mostBytes="20").select("name").collect()[0][0] == "2.txt"
    assert folders.catalog_files(spark, SOURCES[2:], str(tmp_path)).count() == 0
    units, errors = ingest.units(got, SOURCES)
    assert sorted((r["source"], r["unit_key"], r["speaker"], r["content"]) for r in units.collect()) == [("bodies", "page-0001", None, "first"), ("bodies", "page-0002", None, "second"), ("notes", "para-0001", None, "one"), ("notes", "para-0002", None, "two é"), ("notes", "turn-0001", "Ana", "hello"), ("notes", "turn-0002", "Bo", "there")]
    assert errors.count() == 0


def test_files_are_dealt_by_size(tmp_path):
    files = [folders.File("s", str(k), size, 0) for k, size in enumerate([5, 5, 1, 100, 1, 1])]
    assert [[f.bytes for f in p.files] for p in folders.packed(files, 10)] == [[5, 5], [1], [100], [1, 1]] and folders.packed([], 10) == []
    put(tmp_path, "here", "x")
    rows = [r for b in folders.batches([folders.File("s", f"file://{tmp_path}/gone", 1, 0), folders.File("s", f"file://{tmp_path}/here", 1, 0)]) for r in b.to_pylist()]
    assert rows[0]["content"] is None and "FileNotFound" in rows[0]["error"] and rows[1]["content"] == b"x"


def test_a_task_holds_one_batch_of_few_bytes_or_one_file(tmp_path):
    sizes = [700_000] * 16 + [5_000_000] + [300_000] * 9
    for k, size in enumerate(sizes):
        put(tmp_path, f"{k:02}", "x" * size)
    files = [folders.File("s", f"file://{tmp_path}/{k:02}", size, 0) for k, size in enumerate(sizes)]
    tracemalloc.start()
    try:
        before, held, read = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes(), [], []
        for batch in folders.batches(files):
            held.append(tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before)
            read += [len(v.as_buffer()) for v in batch["content"]]
    finally:
        tracemalloc.stop()
    assert read == sizes
    assert max(held) < 5_500_000 and sorted(held)[-2] < 1_500_000


def test_a_stream_of_files_goes_on_from_its_checkpoint(spark, tmp_path):
    with Scope(spark, "files") as scope:

        def run():
            stream = folders.catalog_files(spark, SOURCES, str(tmp_path), stream=True).select("source", "name", "bytes")
            stream.writeStream.format("parquet").option("path", scope.folder("out")).option("checkpointLocation", scope.folder("state")).trigger(availableNow=True).start().awaitTermination()
            return sorted(r["name"] for r in spark.read.schema("source string, name string, bytes long").parquet(scope.folder("out")).collect())

        put(tmp_path, "a/notes/1.txt", "x", 1000)
        put(tmp_path, "a/notes/2.txt", "x", 2000)
        assert run() == ["1.txt", "2.txt"]
        put(tmp_path, "a/notes/3.txt", "x", 2000)  # of the same moment as the latest that was read
        put(tmp_path, "b/4.txt", "x", 4000)
        assert run() == ["1.txt", "2.txt", "3.txt", "4.txt"]
        assert run() == ["1.txt", "2.txt", "3.txt", "4.txt"]
