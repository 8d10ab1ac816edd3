"""Running streams whose operators keep typed state (values, lists and maps by key, timers in event time).

Each call of a stateful processor, and each of its reads and writes of state, costs a round trip between
Spark and Python: some milliseconds a key. Operators over many small keys therefore group by
buckets of keys (``by_bucket``) and keep what they know of a bucket in one typed value.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_SETTLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Buckets of keys. A stream's checkpoint holds to them.
BUCKETS = 1024
#: Partitions of state that each core gets at most: one costs about a second of its core in every micro-batch, however little is in it.
PARTITIONS_A_CORE = 4


def by_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> GroupedData:
    """Rows grouped by buckets of a key, for a processor that keeps all keys of a bucket."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("bucket")


def last_millis(rows: pd.DataFrame, key: str) -> dict:
    """Of each key its last time (``at``) in milliseconds, as timers count."""
    return pd.Series(rows["at"].to_numpy().astype("datetime64[ms]").astype("int64")).groupby(rows[key].to_numpy()).max().to_dict()


@contextmanager
def typed_state(spark: SparkSession, settle: bool = True) -> Iterator[None]:
    """The state store that typed state needs, and partitions by the cluster's cores, for the streams started inside.
    Unless they are to ``settle``, time doesn't pass after their last micro-batch until there is more to read."""
    some = min(int(spark.conf.get(_PARTITIONS)), PARTITIONS_A_CORE * spark.sparkContext.defaultParallelism)
    wanted = {_PROVIDER: _ROCKSDB, _PARTITIONS: str(some), _SETTLE: str(settle).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def feed(part: DataFrame, folder: str, number: int) -> None:
    """Adds a part to a folder that a stream reads, in as many files as tasks make."""
    part.write.mode("error").parquet(f"{folder}/{number:06d}")


def fed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stream of a folder's parts; those that are there when it is run make one micro-batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def run_on(stream: DataFrame, table: str, checkpoint: str, settle: bool = True) -> DataFrame:
    """Runs a stream over what there is since its checkpoint, adds its rows to the table at ``table``, and
    returns all of them. Called again, also by another process, it goes on where it was."""
    spark = stream.sparkSession
    with typed_state(spark, settle):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)
