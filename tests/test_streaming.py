from collections import Counter

from millrace.streaming import events


def test_stream_results_are_files(spark, tmp_path):
    rows = [(k % 7, "ab"[k % 2], "2024-01-01 00:00:00", 1.0) for k in range(100)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").repartition(3).write.parquet(path)
    got = events.counts(spark, path)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == Counter((u, t) for u, t, _, _ in rows)
    assert got.inputFiles() and events.tumbling(spark, path).inputFiles()
