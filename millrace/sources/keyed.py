"""A table kept by key, stored as files: changes rewrite only the hash buckets that they touch.

Each version is a manifest, a small file that names the folder of every bucket; it is made at once
and never changed. A change writes new folders beside the old ones and then the next manifest, so a
writer that dies leaves the table as it was, and of two writers the second starts again on the
first one's version. Folders that no kept manifest names go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import create_text, delete, names, read_text

#: How often a change starts again when other writers are first.
TRIES = 20

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    keys: list[str]
    by: list[str]
    buckets: int
    #: bucket -> the folder that its rows are in
    folders: dict[str, str] = field(default_factory=dict)
    #: stream -> its last micro-batch that is in the table
    applied: dict[str, int] = field(default_factory=dict)


def latest(keys: list[str], at: str) -> Merge:
    """Of each key the row that is last by ``at`` (null first; ties by the whole row)."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        # maps can't be compared; their text can
        order = F.struct(F.col(at), F.to_json(F.struct(*rows.columns)))
        return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")

    return merge


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        """Opens a table that ``create`` has made."""
        self.spark, self.path = spark, path.rstrip("/")
        if self.version() is None:
            raise FileNotFoundError(f"no keyed table at {path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> KeyedTable:
        """A new empty table, or the one that is there. Rows are filed by a hash of ``by`` (some of the keys; by
        default all): changes that name only these still touch only their buckets."""
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        by = by or keys
        if not set(by) <= set(keys) <= set(kind.names):
            raise ValueError("rows are filed by keys, and keys are columns")
        first = Manifest(0, kind.json(), keys, by, buckets)
        create_text(spark, f"{path.rstrip('/')}/manifest/{0:012d}.json", json.dumps(asdict(first)))
        return cls(spark, path)

    # --- reading -----------------------------------------------------------------------------

    def version(self) -> int | None:
        found = [int(n[:-5]) for n in names(self.spark, f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit()]
        return max(found, default=None)

    def manifest(self, version: int | None = None) -> Manifest:
        return Manifest(**json.loads(read_text(self.spark, f"{self.path}/manifest/{self.version() if version is None else version:012d}.json")))

    def _rows(self, head: Manifest, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(head.schema))
        paths = [f"{f}/bucket={b}" for b, f in head.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows now, or in an earlier version that hasn't been vacuumed. What is read stays as it
        is when the table changes."""
        return self._rows(self.manifest(version))

    # --- changing ----------------------------------------------------------------------------

    def _bucket(self, head: Manifest) -> Column:
        return F.pmod(F.xxhash64(*head.by), F.lit(head.buckets)).alias("bucket")

    def _write(self, rows: DataFrame, head: Manifest, place: str) -> tuple[str, set[str]]:
        """Files rows by bucket in a new folder: (folder, its buckets)."""
        folder = f"{self.path}/{place}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(head)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        return folder, {n[7:] for n in names(self.spark, folder) if n.startswith("bucket=")}

    def _change(self, changes: DataFrame, merge: Merge, stream: str | None = None, batch: int | None = None) -> int:
        staged, base = None, None
        try:
            for _ in range(TRIES):
                head = self.manifest()
                if stream is not None and head.applied.get(stream, -1) >= batch:
                    return head.version  # a micro-batch that is told again
                if staged is None or head.buckets != base:
                    staged, base = self._write(changes, head, "staged"), head.buckets
                folder, touched = staged
                applied = head.applied | ({stream: batch} if stream is not None else {})
                if touched:
                    new = self.spark.read.schema(changes.schema).parquet(*[f"{folder}/bucket={b}" for b in sorted(touched)])
                    columns = StructType.fromJson(json.loads(head.schema)).names
                    out, filled = self._write(merge(self._rows(head, touched), new).select(*columns), head, "data")
                    kept = {b: f for b, f in head.folders.items() if b not in touched} | {b: out for b in filled}
                    head = replace(head, folders=kept)
                elif stream is None:
                    return head.version
                if create_text(self.spark, f"{self.path}/manifest/{head.version + 1:012d}.json", json.dumps(asdict(replace(head, version=head.version + 1, applied=applied)))):
                    return head.version + 1
            raise RuntimeError(f"{TRIES} times other writers of {self.path} were first")
        finally:
            if staged is not None:
                delete(self.spark, staged[0])

    def upsert(self, rows: DataFrame, merge: Merge, stream: str | None = None, batch: int | None = None) -> int:
        """Merges rows into the table and returns its version. ``merge`` gets the rows of the touched buckets
        and the new ones, and returns what these buckets hold from now on; keys stay in their buckets.
        A micro-batch (``stream``, ``batch``) that is in the table already changes nothing."""
        return self._change(rows, merge, stream, batch)

    def remove(self, values: DataFrame) -> DataFrame:
        """Removes the rows that agree with one of ``values`` in all its columns (keys, at least those by which
        rows are filed), and returns them. Values that aren't there change nothing."""
        on = values.columns
        gone = f"{self.path}/removed/{uuid.uuid4().hex}"
        head = self.manifest()
        if not set(head.by) <= set(on) <= set(head.keys):
            raise ValueError(f"rows are removed by keys, {head.by} at least")

        def without(old: DataFrame, new: DataFrame) -> DataFrame:
            same = [old[c].eqNullSafe(F.col(f"n.{c}")) for c in on]
            old.join(new.alias("n"), same, "left_semi").write.mode("overwrite").parquet(gone)
            return old.join(new.alias("n"), same, "left_anti")

        self._change(values.distinct(), without)
        schema = StructType.fromJson(json.loads(head.schema))
        return self.spark.read.schema(schema).parquet(gone) if names(self.spark, gone) else self.spark.createDataFrame([], schema)

    def rebucket(self, buckets: int) -> int:
        """Files all rows anew in another number of buckets, as the table grows."""
        head = replace(self.manifest(), buckets=buckets)
        folder, filled = self._write(self._rows(head), head, "data")
        if not create_text(self.spark, f"{self.path}/manifest/{head.version + 1:012d}.json", json.dumps(asdict(replace(head, version=head.version + 1, folders={b: folder for b in filled})))):
            raise RuntimeError("another writer was first")
        return head.version + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last ``keep``, and folders that none of these names; returns how many folders
        went. To be called when nothing writes: the folders of a change under way have no manifest yet."""
        versions = sorted(int(n[:-5]) for n in names(self.spark, f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit())
        needed = {f for v in versions[-keep:] for f in self.manifest(v).folders.values()}
        for v in versions[:-keep]:
            delete(self.spark, f"{self.path}/manifest/{v:012d}.json")
        unused = [f"{self.path}/data/{n}" for n in names(self.spark, f"{self.path}/data") if f"{self.path}/data/{n}" not in needed]
        return sum(delete(self.spark, f) for f in unused)
