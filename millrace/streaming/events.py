"""Event streams: windowed aggregates with watermarks, drained once by availableNow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable, latest
from ..sources.storage import Scope

#: Turns that a session's window holds.
WINDOW = 6


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream; ``ts`` is made a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a parquet path is a folder of part files, asked of the file system that Spark reads."""
    files = spark.read.parquet(path).inputFiles()
    return bool(files) and not files[0].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2])


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors both write."""
    return Scope(spark, "stream").root


def drain(stream: DataFrame) -> DataFrame:
    """Runs a stream over what there is and returns its last result table (aggregates only).

    Each micro-batch writes the table as Parquet, a folder of its own; no row passes through the driver.
    """
    spark = stream.sparkSession
    folder, done = shared_folder(spark), []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/table-{batch}")
        done.append(batch)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table-{done[-1]}")


def tumbling(spark: SparkSession, path: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by day and type."""
    events = read_events(spark, path).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drain(grouped).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 6).alias("total"))


def counts(spark: SparkSession, path: str) -> DataFrame:
    return drain(read_events(spark, path).groupBy("user_id", "event_type").agg(F.count("*").alias("n")))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: a pause of ``gap`` or more ends one."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))

def last_of_each(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream in update mode over what there is: of each key the row of its last micro-batch.

    Late rows are dropped as the stream's watermark says. Every micro-batch writes a folder of its own.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/table/{batch}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = stream.select("*", F.lit(0).alias("__batch")).schema
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/table")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("row")).select("row.*")


def appended(stream: DataFrame) -> DataFrame:
    """Runs a stream in append mode over what there is and returns all rows it gave."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def in_order(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """Tables as a stream that gives them one after the other, each as one micro-batch."""
    folder = shared_folder(spark)
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k:04d}")
    # a file stream takes older files first, and one file at a time here
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def sliding(events: DataFrame, width: str = "2 days", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by type in overlapping windows of a stream of events."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, every), "event_type").agg(F.count("*").alias("n"))
    return drain(grouped).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "40 days") -> DataFrame:
    """Events of a stream, each key once within the watermark."""
    return appended(events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]))


def daily_without_late(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day and type; rows that come after the watermark has passed their day are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return last_of_each(grouped, ["window", "event_type"]).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def upserted(rows: DataFrame, key: str, at: str, path: str | None = None, buckets: int = 32) -> DataFrame:
    """A table kept by key: every micro-batch of a stream replaces the rows of its keys (the latest of
    each, by ``at``), so what is ingested again does not double.

    The table and the stream's checkpoint are at ``path``: called again, also by another process, it
    goes on where it was. Only the buckets of a micro-batch's keys are rewritten, and a micro-batch
    that is told again changes nothing.
    """
    spark = rows.sparkSession
    path = path or shared_folder(spark)
    table = KeyedTable.create(spark, f"{path}/table", rows.schema, [key], buckets=buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch.select(*rows.columns), latest([key], at), "rows", number)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read()


_TURNS = "conv_id long, turn long, role string, turn_index long, in_window long, anchors long, known string"
_STATE = "turns long, anchors long, known string"


def _turns(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The turns of one conversation after those of earlier micro-batches: counts and what is remembered."""
    turns, anchors, known = state.get if state.exists else (0, 0, None)
    out = []
    # Arrow may give a conversation's rows in several pieces: they are put in order together
    for r in pd.concat(list(batches)).sort_values(["turn", "role", "text"], kind="stable").itertuples():
        turns += 1
        anchors += int("?" in r.text)
        known = r.lang or known
        out.append((key[0], r.turn, r.role, turns, min(turns, WINDOW), anchors, known))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _TURNS.split(", ")])
    state.update((turns, anchors, known))


def session_turns(turns: DataFrame) -> DataFrame:
    """Turns of a stream of conversations (conv_id, turn, role, text, lang) with the state of their
    session: place, messages in the window, statements to keep, and the last language that was told.

    State is a row a conversation in the state store; a session's own turns arrive in order."""
    return appended(turns.groupBy("conv_id").applyInPandasWithState(_turns, _TURNS, _STATE, "append", "NoTimeout"))


def assembled(deltas: DataFrame, by: str = "stream_id", place: str = "seq", text: str = "delta") -> DataFrame:
    """The text of each stream of deltas that has its end mark (``done``), in order of their numbers."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t"))))
    return deltas.groupBy(by).agg(F.array_join(F.transform(parts, lambda r: r["t"]), "").alias("text"), F.max("done").alias("done")).where("done").drop("done")
