"""The folders of a catalog as a Spark data source, for batches and streams of files.

``spark.read.format("catalog_files")`` and ``spark.readStream.format("catalog_files")`` give a row for each
file of the catalog's sources. The listing is made when the read is planned: sources that aren't named
aren't listed, files that the options leave out aren't opened, and the others are dealt to tasks by
their size. Any store that Arrow opens by its address will do. ``operators.ingest.units`` makes units
of the rows.

Files are picked by options and not by Spark's hook for conditions: in Spark 4.1 all scans of one
loaded table share what was planned for the last of them, so that a table with two conditions (a
union of two of its parts, say) would lose rows.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "catalog_files"
SCHEMA = "source string, path string, name string, bytes long, modified timestamp, content binary, error string"
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20
#: Bytes of files that one Arrow batch holds; a larger file is a batch of its own.
BATCH_BYTES = 1 << 20

@dataclass(frozen=True)
class File:
    source: str
    path: str
    bytes: int
    modified: int  # microseconds


@dataclass
class Files(InputPartition):
    files: list[File]


def listing(sources: list[dict], root: str) -> list[File]:
    """The files of all sources, by source and path. A location is ``scheme://logical/path`` below the root; a
    folder that is missing has no files. Names that begin with _ or . are no data."""
    out = []
    for source in sources:
        address = f"{root.rstrip('/')}/{source['location'].partition('://')[2].strip('/')}"
        fs, path = pafs.FileSystem.from_uri(address if "://" in address else f"file://{address}")
        prefix = address[: len(address) - len(path)] if address.endswith(path) else "file://"
        for found in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)):
            hidden = any(part.startswith(("_", ".")) for part in found.path[len(path) :].strip("/").split("/"))
            if found.type == pafs.FileType.File and not hidden and fnmatch.fnmatch(found.base_name, source.get("pattern") or "*"):
                out.append(File(source["name"], f"{prefix}{found.path}", found.size, int(found.mtime_ns // 1000)))
    return sorted(out, key=lambda f: (f.source, f.path))


def packed(files: list[File], most: int = TASK_BYTES) -> list[Files]:
    """Files in their order in groups of about ``most`` bytes, one at least in each."""
    groups, size = [], 0
    for f in files:
        if not groups or size + f.bytes > most:
            groups.append([])
            size = 0
        groups[-1].append(f)
        size += f.bytes
    return [Files(g) for g in groups]


def _row(f: File) -> tuple:
    content, error = None, None
    try:
        fs, path = pafs.FileSystem.from_uri(f.path)
        with fs.open_input_file(path) as file:  # its size is known, so it is read in one piece
            content = file.read()
    except OSError as e:
        error = f"{type(e).__name__}: {str(e)[:200]}"
    return f.source, f.path, f.path.rpartition("/")[2], f.bytes, f.modified, content, error


def batches(files: Iterable[File]) -> Iterator[pa.RecordBatch]:
    """The files' rows; a file that can't be read tells its error and doesn't stop the others. While a batch is
    out, nothing else is held: a task's memory goes with its largest file, not with its share of all."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        names = ["source", "path", "name", "bytes", "modified", "content", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows, size = [], 0
    for f in files:
        if rows and size + f.bytes > BATCH_BYTES:
            yield made(rows)
            size = 0
        rows.append(_row(f))
        size += f.bytes
    if rows:
        yield made(rows)


@dataclass(frozen=True)
class _Given:
    """What the options ask for."""

    sources: list[dict]
    root: str
    task_bytes: int = TASK_BYTES
    after: int = -(1 << 62)
    most: int = 1 << 62

    def files(self) -> list[File]:
        return [f for f in listing(self.sources, self.root) if f.modified > self.after and f.bytes <= self.most]


class _Reader(DataSourceReader):
    def __init__(self, given: _Given) -> None:
        self.given = given

    def partitions(self) -> list[InputPartition]:
        return packed(self.given.files(), self.given.task_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(partition.files)


class _Stream(DataSourceStreamReader):
    """Files in order of their last change. An offset is the latest change that was read, with the paths that
    have just that time, so that a file of the same moment isn't lost. A file that turns up with an
    older time than what was read isn't seen."""

    def __init__(self, given: _Given) -> None:
        self.given = given

    def initialOffset(self) -> dict:
        return {"modified": -1, "paths": []}

    def latestOffset(self) -> dict:
        files = self.given.files()
        if not files:
            return self.initialOffset()
        last = max(f.modified for f in files)
        return {"modified": last, "paths": sorted(f.path for f in files if f.modified == last)}

    @staticmethod
    def is_after(file: File, offset: dict) -> bool:
        return file.modified > offset["modified"] or file.modified == offset["modified"] and file.path not in offset["paths"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return packed([f for f in self.given.files() if self.is_after(f, start) and not self.is_after(f, end)], self.given.task_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(partition.files)

    def commit(self, end: dict) -> None:
        pass


class CatalogFiles(DataSource):
    """Options: ``path`` (the root), ``sources`` (JSON list of name, location and, if not all files, pattern),
    ``modifiedAfter`` (a time with its zone), ``mostBytes`` (of a file), ``taskBytes`` (of files that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> _Given:
        after = self.options.get("modifiedAfter")
        more = {"after": int(dt.datetime.fromisoformat(after).timestamp() * 1e6)} if after else {}
        more |= {to: int(self.options[name]) for name, to in (("mostBytes", "most"), ("taskBytes", "task_bytes")) if name in self.options}
        return _Given(json.loads(self.options["sources"]), self.options["path"], **more)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._given())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._given())


def catalog_files(spark: SparkSession, sources: list[dict], root: str, stream: bool = False, **options: str) -> DataFrame:
    """The files of a catalog's sources (name, location, pattern) as a table or as a stream."""
    spark.dataSource.register(CatalogFiles)
    plain = json.dumps([{k: s.get(k) for k in ("name", "location", "pattern")} for s in sources])
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("path", root).option("sources", plain).options(**options).load()
